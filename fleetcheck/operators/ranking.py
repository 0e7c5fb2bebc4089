"""Ranking: top-n per group, latest row per key, recent failures, Pareto.

Top-n per group is ``row_number() <= n`` over a window partitioned by the
group: Spark plans a partial ``WindowGroupLimit`` *before* the shuffle, so
each map task forwards at most n rows per group and a hot group costs no
more than a cold one. A top-n with no group is ``orderBy().limit(n)``,
planned as ``TakeOrderedAndProject`` (per-partition top-n, then merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, fround, nz
from ..session import ensure_checkpoint_dir


def _orders(order: Sequence) -> list[Column]:
    return [col(o) for o in order]


def topn(df: DataFrame, order: Sequence, n: int, part: Sequence[str] = (),
         rank_col: str = "rn", fn: str = "row_number") -> DataFrame:
    """Top ``n`` rows per ``part`` by ``order`` (include a unique tie-break).

    fn: row_number (exactly n), rank or dense_rank (ties kept).
    """
    part = list(part)
    if not part:
        if fn != "row_number":
            # Ties with the n-th row are kept. Spark limits a rank filter per task before the one window task.
            w = Window.orderBy(*_orders(order))
            return df.withColumn(rank_col, getattr(F, fn)().over(w)).filter(F.col(rank_col) <= n)
        top = df.orderBy(*_orders(order)).limit(n)
        w = Window.orderBy(*_orders(order))  # at most n rows reach this window
        return top.withColumn(rank_col, getattr(F, fn)().over(w))
    w = Window.partitionBy(*part).orderBy(*_orders(order))
    return df.withColumn(rank_col, getattr(F, fn)().over(w)).filter(F.col(rank_col) <= n)


def topn_per_group(df: DataFrame, part: Sequence[str], order: Sequence, n: int,
                   rank_col: str = "rn") -> DataFrame:
    return topn(df, order, n, part, rank_col)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str],
                   values: Sequence[str]) -> DataFrame:
    """Newest row per key as one aggregate: ``max_by(struct(values), struct(order))``.

    Partial aggregation keeps one candidate per key per map task, so a key
    holding a third of the rows never gathers in one task.
    """
    key = list(key)
    packed = F.max_by(F.struct(*[col(v) for v in values]), F.struct(*[col(o) for o in order]))
    out = df.groupBy(*key).agg(packed.alias("_latest"))
    return out.select(*key, *[F.col(f"_latest.{v}").alias(v) for v in values])


def recent_failures(log: DataFrame, key: Sequence[str], order: Sequence, k: int,
                    failed: Column, since: Column | None = None, ts=None,
                    rank_col: str = "rnk") -> DataFrame:
    """Non-success rows in the window, ``dense_rank() <= k`` per key."""
    df = log.filter(failed)
    if since is not None:
        df = df.filter(col(ts) >= since)
    w = Window.partitionBy(*key).orderBy(*_orders(order))
    return df.withColumn(rank_col, F.dense_rank().over(w)).filter(F.col(rank_col) <= k)


def pareto(df: DataFrame, metric: str, key: str, part: Sequence[str] = (), n: int | None = None,
           digits: int = 4) -> DataFrame:
    """Percent of the (already filtered) total and running percent, top ``n``.

    ``df`` is one row per category (already aggregated, so its size is the
    number of categories per instance). The running total is a window frame
    (``ROWS UNBOUNDED PRECEDING``) instead of a triangular self-join.
    Percentages are computed from exact running sums, then rounded once.
    """
    part = list(part)
    order = [F.col(metric).desc(), F.col(key).asc()]
    if part:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = (df.withColumn("_total", F.sum(metric).over(Window.partitionBy(*part)))
                 .withColumn("_running", F.sum(metric).over(w)).withColumn("rn", F.row_number().over(w)))
    elif n is not None:
        # the running sums of the first n rows need no others; the total is a partial aggregate of its own
        total = df.select(F.sum(metric)).scalar()
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # n rows
        out = topn(df, order, n).withColumn("_total", total).withColumn("_running", F.sum(metric).over(w))
    else:
        out = ordered_prefix(df, order, metric)
    out = (out.withColumn("pct", fround(F.lit(100.0) * F.col(metric).cast("double") / nz(F.col("_total").cast("double")), digits))
              .withColumn("running_pct", fround(F.lit(100.0) * F.col("_running").cast("double") / nz(F.col("_total").cast("double")), digits))
              .drop("_total", "_running"))
    if n is not None:
        out = out.filter(F.col("rn") <= n)
    return out


def ordered_prefix(df: DataFrame, order: Sequence[Column], metric: str, partitions: int | None = None) -> DataFrame:
    """Each row's place ``rn``, the running sum ``_running`` of a metric along a total order, and its ``_total``, without one task for all.

    Rows are dealt by ranges of the order and pinned by a reliable checkpoint (the bounds are drawn from a sample, so a
    second reading must not deal them anew). One row for each range holds its size and sum; their prefixes are a window
    over these few, and within a range both run over its rows alone.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    k = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(k, *order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(metric).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # k rows at most
    sizes = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.sum("_s").over(before).alias("_sum"),
                         F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = dealt.withColumn("_here", F.sum(metric).over(w)).withColumn("_at", F.row_number().over(w))
    out = here.join(F.broadcast(sizes), F.col("_range") == F.col("_of"))
    kinds = dict(out.dtypes)
    zero = F.lit(0).cast(kinds["_sum"])
    # sums of nothing but NULLs are NULL, as a window's are
    running = F.when(F.col("_sum").isNotNull() | F.col("_here").isNotNull(), F.coalesce("_sum", zero) + F.coalesce("_here", zero))
    return out.withColumn("rn", (F.col("_rows") + F.col("_at")).cast("int")).withColumn("_running", running).drop("_range", "_of", "_rows", "_sum", "_here", "_at")
