"""Performance history: snapshot pairs, counter deltas, rates, ratios, shares, trends.

Counters are long-form ``(instance, snap, stat, value)``. A delta is one
join to the chosen snapshot pair plus ONE conditional aggregation (the
reference scans the history once per statistic in a UNION ALL of branches).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, flag, fround, lsn_to_number, nz, safe_div
from .ranking import topn


def snapshot_pair(snaps: DataFrame, part: Sequence[str], snap: str, startup: str) -> DataFrame:
    """Newest adjacent (begin, end) snapshot pair per instance without a restart
    in between: ``lead(snap)`` within equal ``startup``, newest end wins."""
    part = list(part)
    s = snaps.select(*part, snap, startup).distinct()
    w = Window.partitionBy(*part, startup).orderBy(snap)
    pairs = s.withColumn("end_snap", F.lead(snap).over(w)).filter(F.col("end_snap").isNotNull())
    return (pairs.groupBy(*part)
                 .agg(F.max_by(F.struct(F.col(snap).alias("begin_snap"), "end_snap"), F.col("end_snap")).alias("_p"))
                 .select(*part, "_p.begin_snap", "_p.end_snap"))


def snapshot_delta(stats: DataFrame, pair: DataFrame, part: Sequence[str], snap: str,
                   key: Sequence[str], value: str) -> DataFrame:
    """``end - begin`` per key for the pair; both ends required; a negative
    delta (counter reset) becomes NULL."""
    part, key = list(part), list(key)
    j = stats.join(pair, part).filter((F.col(snap) == F.col("begin_snap")) | (F.col(snap) == F.col("end_snap")))
    agg = j.groupBy(*part, *key).agg(
        F.max(F.when(F.col(snap) == F.col("begin_snap"), col(value))).alias("begin_value"),
        F.max(F.when(F.col(snap) == F.col("end_snap"), col(value))).alias("end_value"),
        F.first("begin_snap").alias("begin_snap"), F.first("end_snap").alias("end_snap"))
    agg = agg.filter(F.col("begin_value").isNotNull() & F.col("end_value").isNotNull())
    d = F.col("end_value") - F.col("begin_value")
    return agg.withColumn("delta", F.when(d >= 0, d))


def rate_per_second(df: DataFrame, delta: str, seconds, digits: int = 6, out: str = "per_sec") -> DataFrame:
    """delta / seconds (a column or a constant)."""
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return df.withColumn(out, fround(safe_div(delta, s), digits))


def hit_ratio(misses, total, digits: int = 2) -> Column:
    """``100 * (1 - misses/total)``, NULL when total is 0."""
    return fround(F.lit(100.0) * (F.lit(1.0) - safe_div(misses, total)), digits)


def share_ratio(a, b, digits: int = 2) -> Column:
    """``100 * a / (a + b)``, NULL when a + b is 0."""
    return fround(F.lit(100.0) * safe_div(a, col(a) + col(b)), digits)


def ratio_kpi(df: DataFrame, ratios: dict, red_below: float | None = None) -> DataFrame:
    """Add ratio columns; ``ratios`` maps name -> Column (see ``hit_ratio``)."""
    for name, expr in ratios.items():
        df = df.withColumn(name, expr)
    if red_below is not None:
        cond = None
        for name in ratios:
            c = F.col(name) < red_below
            cond = c if cond is None else (cond | c)
        df = df.withColumn("is_abnormal", flag(cond))
    return df


def time_share(df: DataFrame, part: Sequence[str], key: str, value: str,
               exclude: Sequence[str] = (), digits: int = 2, out: str = "pct") -> DataFrame:
    """Each key's share of the per-instance total; ``exclude`` keys (totals,
    idle) are kept but get NULL and do not count in the total."""
    part = list(part)
    keep = ~col(key).isin(list(exclude)) if exclude else F.lit(True)
    counted = F.sum(F.when(keep, col(value)))
    # without an instance the total is a partial aggregate of its own, not a window of one task
    tot = counted.over(Window.partitionBy(*part)) if part else df.select(counted).scalar()
    return df.withColumn(out, F.when(keep, fround(F.lit(100.0) * col(value).cast("double") / nz(tot.cast("double")), digits)))


def sql_window_stats(stats: DataFrame, part: Sequence[str], stmt: Sequence[str], ts: str,
                     begin: Column, end: Column, sums: dict, execs: str | None = None,
                     share_of: str | None = None, share: str = "pct_total", digits: int = 4, most: dict | None = None) -> DataFrame:
    """Sum per-statement deltas for ``begin < ts <= end``. ``sums`` maps output -> value column, ``most`` output -> column
    whose largest value is kept; ``execs`` names the execution-count column (counted rows when None). ``share_of`` names an
    output whose percentage of the in-window total per instance is added as ``share``; totals are
    summed from the statements' rows and joined back, so a hot instance is no window of one task.
    Both branches use all columns, so that Spark aggregates and shuffles the statements once."""
    part, stmt = list(part), list(stmt)
    w = stats.filter((col(ts) > begin) & (col(ts) <= end))
    aggs = [F.sum(v).alias(o) for o, v in sums.items()] + [F.max(v).alias(o) for o, v in (most or {}).items()]
    aggs.append((F.sum(execs) if execs else F.count("*")).alias("execs"))
    g = w.groupBy(*part, *stmt).agg(*aggs)
    if share_of is None:
        return g
    # A total of no more columns than it needs would be another aggregate of the same rows, with a scan and a shuffle of its own.
    every = F.bit_xor(F.xxhash64(*stmt, *sums, *(most or {}), "execs"))
    total = g.groupBy(*part).agg(F.sum(share_of).alias("_total"), every.alias("_every")).filter(F.col("_every").isNotNull())
    return (g.join(total.drop("_every"), part).withColumn(share, fround(
        F.lit(100.0) * col(share_of).cast("double") / nz(F.col("_total").cast("double")), digits)).drop("_total"))


def with_texts(g: DataFrame, texts: DataFrame, on: Sequence[str], text: str, not_like: Sequence[str] = ()) -> DataFrame:
    """Statements with their texts; those without one, or with one like an excluded pattern, go.

    The keys are compared as one struct: a plain equality would send "is not null" down into the statements'
    aggregate here, but not in the branch of the totals, and the two would not be one shuffle any more.
    """
    wanted = texts.select(*on, text).filter(F.col(text).isNotNull()).dropna(subset=list(on))
    for pattern in not_like:
        wanted = wanted.filter(~F.col(text).like(pattern))
    wanted = wanted.select(F.struct(*on).alias("_of"), text)
    return g.withColumn("_key", F.struct(*on)).join(wanted, F.col("_key") == F.col("_of")).drop("_key", "_of")


def statement_report(stats: DataFrame, part: Sequence[str], stmt: str, ts: str, begin: Column, end: Column, sums: dict, rank_by: str,
                     n: int, execs: str | None = None, shares: dict | None = None, totals: DataFrame | None = None, total: str | None = None,
                     texts: DataFrame | None = None, text: str | None = None, not_like: Sequence[str] = (), text_on: Sequence[str] | None = None,
                     digits: int = 2, per_exec: str = "per_exec", share: str = "pct_total", most: dict | None = None) -> DataFrame:
    """The ``n`` heaviest statements of each instance between two snapshots.

    Sums as ``sql_window_stats``; ``per_exec`` of ``rank_by``; ``shares`` (%cpu, %io): output -> (part, whole) of two
    sums. ``share`` is the percentage of ``rank_by`` in a ``total`` that an instance has in ``totals``, or else in the
    sum over its statements. A statement whose ``text`` is like one of ``not_like`` is none of the ``n``, nor is one
    without a text (``NOT LIKE`` of NULL); it still counts in the sum. Texts are fetched for the rest only to be tested.
    """
    part = list(part)
    g = sql_window_stats(stats, part, [stmt], ts, begin, end, sums, execs, rank_by if totals is None else None, share, digits, most)
    if totals is not None:
        g = g.join(totals.select(*part, col(total).alias("_total")), part, "left")
        g = g.withColumn(share, fround(F.lit(100.0) * safe_div(rank_by, "_total"), digits)).drop("_total")
    if texts is not None:
        g = with_texts(g, texts, list(text_on or [stmt]), text, not_like)
    g = g.withColumn(per_exec, fround(safe_div(rank_by, "execs"), digits))
    for out, (a, b) in (shares or {}).items():
        g = g.withColumn(out, fround(F.lit(100.0) * safe_div(a, b), digits))
    return topn(g, [F.col(rank_by).desc_nulls_last(), F.col(stmt).asc()], n, part)


def counter_trend(counters: DataFrame, part: Sequence[str], key: Sequence[str], snap: str,
                  value: str, interval_s, digits: int = 6, out: str = "rate") -> DataFrame:
    """Per-snap rate from cumulative counters: (v - lag(v, default v)) / interval,
    so the first snap is 0 (``LAG(x, 1, x)``)."""
    w = Window.partitionBy(*part, *key).orderBy(snap)
    prev = F.coalesce(F.lag(value).over(w), col(value))
    s = interval_s if isinstance(interval_s, Column) else F.lit(float(interval_s))
    return counters.withColumn(out, fround((col(value) - prev).cast("double") / nz(s), digits))


def sequence_gap(df: DataFrame, part: Sequence[str], seq: str, applied: Column,
                 red: float = 0, current: DataFrame | None = None) -> DataFrame:
    """Max applied vs max current position per stream; gap = current - applied. ``current`` is the
    frame whose ``seq`` is the current position, if it is not ``df``: streams of both, as in an inner join."""
    if current is not None:
        a = df.filter(applied).groupBy(*part).agg(F.max(col(seq)).alias("applied"))
        g = a.join(current.groupBy(*part).agg(F.max(col(seq)).alias("current")), list(part))
    else:
        g = df.groupBy(*part).agg(F.max(F.when(applied, col(seq))).alias("applied"),
                                  F.max(col(seq)).alias("current"))
    return (g.withColumn("gap", F.col("current") - F.col("applied"))
             .withColumn("is_abnormal", flag(F.col("gap") > red)))


def position_lag(df: DataFrame, sent: str, replayed: str, red: float | None = None, out: str = "lag_bytes") -> DataFrame:
    """Bytes between two log positions ``hi/lo`` (hex halves); NULL without either, red above ``red``."""
    lag = df.withColumn(out, lsn_to_number(sent) - lsn_to_number(replayed))
    return lag if red is None else lag.withColumn("is_abnormal", flag(F.col(out) > red))
