"""Time checks: durations, ages, expiry windows, day x hour matrices, daily volume/growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, day_str, days_between, flag, seconds_between


def long_running(df: DataFrame, start, as_of: Column, min_s: float, red_s: float,
                 out: str = "elapsed_s") -> DataFrame:
    """Rows running longer than ``min_s`` at ``as_of``; red above ``red_s``."""
    return (df.withColumn(out, seconds_between(start, as_of))
              .filter(F.col(out) > min_s)
              .withColumn("is_abnormal", F.col(out) > red_s))


def age_flag(df: DataFrame, ts, as_of: Column, max_days: float, null_is_bad: bool = True,
             out: str = "age_days") -> DataFrame:
    """Days since ``ts``; NULL (never) is red when ``null_is_bad``; red above ``max_days``."""
    df = df.withColumn(out, days_between(ts, as_of))
    bad = F.col(out) > max_days
    if null_is_bad:
        bad = F.col(out).isNull() | bad
    return df.withColumn("is_abnormal", flag(bad))


def expiry_window(df: DataFrame, ts, as_of, horizon: int, red: int, min_days: int | None = 0,
                  out: str = "days_left") -> DataFrame:
    """Rows expiring within ``horizon`` days of ``as_of``; red when ``<= red``."""
    df = df.withColumn(out, days_between(as_of, ts))
    cond = F.col(out) <= horizon
    if min_days is not None:
        cond = cond & (F.col(out) >= min_days)
    return df.filter(cond).withColumn("is_abnormal", F.col(out) <= red)


def hour_matrix(events: DataFrame, ts: str, part: Sequence[str], cell_red: float, total_red: float,
                since: Column | None = None, until: Column | None = None,
                day_col: str = "day") -> DataFrame:
    """Day x hour counts: one row per (part, day), columns h00..h23 + total.

    24 conditional counts in ONE aggregation (partial agg map-side, one
    shuffle on (part, day)); ``red_cells`` = hours above ``cell_red``,
    ``is_abnormal`` = total above ``total_red``.
    """
    df = events
    if since is not None:
        df = df.filter(col(ts) >= since)
    if until is not None:
        df = df.filter(col(ts) < until)
    df = df.select(*part, day_str(ts).alias(day_col), F.hour(col(ts)).alias("_h"))
    cells = [F.count_if(F.col("_h") == h).alias(f"h{h:02d}") for h in range(24)]
    out = df.groupBy(*part, day_col).agg(*cells, F.count("*").alias("total"))
    red_cells = sum((F.col(f"h{h:02d}") > cell_red).cast("int") for h in range(24))
    return (out.withColumn("red_cells", red_cells)
               .withColumn("is_abnormal", F.col("total") > total_red))


def daily_volume(df: DataFrame, ts: str, value, part: Sequence[str], since: Column | None = None,
                 until: Column | None = None, out: str = "volume", scale: int = 2) -> DataFrame:
    """Per (part, day) exact sum of ``value`` (DECIMAL, order independent)."""
    if since is not None:
        df = df.filter(col(ts) >= since)
    if until is not None:
        df = df.filter(col(ts) < until)
    return (df.groupBy(*part, day_str(ts).alias("day"))
              .agg(F.sum(col(value).cast(f"decimal(18,{scale})")).alias(out)))


def daily_growth(df: DataFrame, entity: Sequence[str], ts: str, value, part: Sequence[str],
                 tie: str | None = None, scale: int = 2) -> DataFrame:
    """Last observation of each day per entity -> per (part, day) total ->
    difference to the previous day of the same part (``lag``).

    The last observation is ``max_by`` (partial aggregation, skew safe); the
    lag window runs over one row per (part, day).
    """
    order = F.struct(col(ts), col(tie)) if tie else col(ts)
    last = (df.groupBy(*part, *entity, day_str(ts).alias("day"))
              .agg(F.max_by(col(value).cast(f"decimal(18,{scale})"), order).alias("_last")))
    tot = last.groupBy(*part, "day").agg(F.sum("_last").alias("total"))
    w = Window.partitionBy(*part).orderBy("day")
    return tot.withColumn("growth", F.col("total") - F.lag("total").over(w))
