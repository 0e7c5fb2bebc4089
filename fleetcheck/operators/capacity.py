"""Capacity: large segments, bloat, auto-extend headroom, partition headroom,
file summaries and host usage ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, decode_date_bytes, flag, fround, nz, pct, safe_div
from .ranking import topn


def large_segments(df: DataFrame, key: Sequence[str], size, min_size: float, n: int,
                   red: float, part: Sequence[str] = (), out: str = "total_size") -> DataFrame:
    """Sum sizes per object, keep ``> min_size`` (HAVING), top ``n`` (per part),
    red above ``red``."""
    key = list(key)
    g = df.groupBy(*part, *key).agg(F.sum(size).alias(out)).filter(F.col(out) > min_size)
    top = topn(g, [F.col(out).desc(), *[F.col(k).asc() for k in key]], n, part)
    return top.withColumn("is_abnormal", F.col(out) > red)


def bloat_estimate(tables: DataFrame, part: Sequence[str], rows: str, actual_pages: str,
                   avg_width: str, page_size: int = 8192, header: int = 24,
                   listed: float = 10.0, red: float = 40.0, digits: int = 2) -> DataFrame:
    """Expected pages from tuple width vs actual pages.

    expected = ceil(rows / greatest(floor(page/(header+width)), 1)) + 1;
    bloat % = 100 * (actual - expected) / actual; listed above ``listed``,
    red above ``red``. Input is one row per table (already aggregated).
    """
    per_page = F.greatest(F.floor(F.lit(float(page_size)) / (F.lit(float(header)) + col(avg_width))), F.lit(1))
    expected = F.ceil(col(rows).cast("double") / per_page) + 1
    out = (tables.withColumn("expected_pages", expected.cast("bigint"))
                 .withColumn("bloat_pct", fround(F.lit(100.0) * (col(actual_pages) - F.col("expected_pages")).cast("double")
                                                  / nz(col(actual_pages).cast("double")), digits)))
    return out.filter(F.col("bloat_pct") > listed).withColumn("is_abnormal", F.col("bloat_pct") > red)


def tuple_layout(colstats: DataFrame, table: Sequence[str], null_frac: str, avg_width: str, align: int = 8) -> DataFrame:
    """Bytes that a tuple's layout takes beside its line pointer, folded from a table's column statistics.

    One aggregate: a table with a nullable column has a null header, of two bytes and the widest column over eight;
    the header is then padded to the next multiple of ``align``. (table..., null_header, layout_bytes, n_columns)
    """
    fold = colstats.groupBy(*table).agg(F.max(F.coalesce(col(null_frac), F.lit(0.0))).alias("_nulls"),
                                        F.max(F.coalesce(col(avg_width), F.lit(0))).cast("double").alias("_wide"), F.count("*").alias("n_columns"))
    header = F.when(F.col("_nulls") > 0, (F.lit(2.0) + F.col("_wide")) / F.lit(8.0)).otherwise(F.lit(0.0))
    fold = fold.withColumn("null_header", header).withColumn("_over", F.col("null_header") % F.lit(float(align)))
    over = F.when(F.col("_over") == 0, F.lit(float(align))).otherwise(F.col("_over"))
    return fold.select(*table, "null_header", (F.col("null_header") + F.lit(float(align)) - over).alias("layout_bytes"), "n_columns")


def layout_bloat(tables: DataFrame, colstats: DataFrame, table: Sequence[str], rows: str, actual_pages: str, null_frac: str = "null_frac",
                 avg_width: str = "avg_width", page_size: int = 8192, page_header: int = 23, pointer: int = 4, align: int = 8,
                 min_pages: int = 8, listed: float = 10.0, red: float = 40.0, digits: int = 1) -> DataFrame:
    """Expected pages from the layout of a table's tuples (null header, alignment padding) vs actual pages.

    expected = ceil(rows / ((page - header) / (pointer + layout bytes))) + 1; tables of no rows, or of up to ``min_pages``
    pages, are left out; tables without statistics have no null header. Listed above ``listed`` percent, red above ``red``.
    The widths of the columns' values are no part of this estimate (``bloat_estimate`` takes them).
    """
    t = tables.filter((col(actual_pages) > min_pages) & (col(rows) > 0)).join(
        tuple_layout(colstats, table, null_frac, avg_width, align), list(table), "left")
    each = F.lit(float(pointer)) + F.coalesce("layout_bytes", F.lit(0.0))
    expected = F.ceil(col(rows).cast("double") / (F.lit(float(page_size - page_header)) / each)) + 1
    out = t.withColumn("expected_pages", expected.cast("bigint"))
    spare = col(actual_pages) - F.col("expected_pages")
    ratio = F.lit(100.0) * spare.cast("double") / col(actual_pages).cast("double")
    out = out.withColumn("bloat_bytes", (F.greatest(spare, F.lit(0)) * page_size).cast("bigint")).filter(ratio > listed)
    return out.withColumn("bloat_pct", fround(ratio, digits)).withColumn("is_abnormal", ratio > red)


def capacity_autoextend(files: DataFrame, free: DataFrame, key: Sequence[str], bytes_col: str,
                        max_col: str, free_col: str, red: float = 90.0, digits: int = 2) -> DataFrame:
    """Used % of allocated size and of the auto-extend maximum per tablespace.

    Files and free space are aggregated separately to one row per key, then
    left-joined (the free side may be missing)."""
    key = list(key)
    f = files.groupBy(*key).agg(F.sum(bytes_col).alias("total_bytes"), F.sum(max_col).alias("max_bytes"),
                                F.count("*").alias("n_files"))
    fr = free.groupBy(*key).agg(F.sum(free_col).alias("free_bytes"))
    j = f.join(fr, key, "left").withColumn("free_bytes", F.coalesce(F.col("free_bytes"), F.lit(0)))
    used = F.col("total_bytes") - F.col("free_bytes")
    return (j.withColumn("used_bytes", used)
             .withColumn("used_pct", pct(used, "total_bytes", digits))
             .withColumn("used_of_max_pct", pct(used, "max_bytes", digits))
             .withColumn("is_abnormal", flag(F.col("used_of_max_pct") >= red)))


def partition_headroom(parts: DataFrame, table: Sequence[str], position: str, cols: Sequence[str],
                       bound_raw: str | None = None, as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """The highest-but-one partition of each range-partitioned table (its upper
    bound is how far the table can still grow before the last partition is
    used). One window over the table's partitions (bounded per table).

    ``bound_raw``: the bound as the catalog holds it, seven bytes of a date, is
    decoded to ``upper_bound``; with ``as_of`` the ``days_left`` to it are
    counted, red from ``days`` down."""
    w = Window.partitionBy(*table).orderBy(F.col(position).desc())
    out = parts.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 2)
    if bound_raw is None:
        return out.select(*table, position, *cols)
    out = out.select(*table, position, *cols, decode_date_bytes(bound_raw).alias("upper_bound"))
    if as_of is None:
        return out
    out = out.withColumn("days_left", F.datediff(F.to_date("upper_bound"), as_of.cast("date")))
    return out if days is None else out.withColumn("is_abnormal", flag(F.col("days_left") <= days))


def file_summary(files: DataFrame, part: Sequence[str], id_col: str, size_col: str) -> DataFrame:
    """Count, total size and the largest file (ties: lowest id) per group."""
    return files.groupBy(*part).agg(
        F.count("*").alias("n_files"), F.sum(size_col).alias("total_size"),
        F.min_by(col(id_col), F.struct(-col(size_col), col(id_col))).alias("largest_id"))


def os_usage(df: DataFrame, used: Column, total: Column, out: str, digits: int = 2) -> DataFrame:
    """Usage percent with a zero guard (swap total 0 -> NULL)."""
    return df.withColumn(out, fround(F.lit(100.0) * safe_div(used, total), digits))
