"""Entity relations: anti/semi joins, backup freshness, index hygiene, locks.

No operator here emits all pairs inside a key group. Where the reference
prints pairs (duplicate / redundant indexes, waiter x holder locks), the
output is one row per member with the size of its partner set and a first
partner (or the partners' range), computed from pre-aggregated partner sets
joined by equality — linear in the input, whatever the skew of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, flag, fround, longest_prefix, nz


def missing_related(entities: DataFrame, related: DataFrame, on, cond: Column | None = None) -> DataFrame:
    """Entities with no qualifying related row (``NOT EXISTS`` -> left_anti)."""
    if cond is not None:
        related = related.filter(cond)
    return entities.join(related, on, "left_anti")


def member_of(df: DataFrame, list_df: DataFrame, on) -> DataFrame:
    """Semi-join filter (``IN (SELECT ...)``)."""
    return df.join(list_df, on, "left_semi")


def guaranteed_rows(spine: DataFrame, df: DataFrame, on: Sequence[str], defaults: dict | None = None,
                    present: str | None = None) -> DataFrame:
    """Every key of ``spine`` with its rows of ``df``, or one row of ``defaults`` where it has none (``(SELECT 1) LEFT JOIN``).

    defaults: column -> value, in the column's type; NULLs in rows that are there are replaced as well (``IFNULL``). The
    columns without a default are NULL. ``present`` names a column that tells rows from stand-ins. The spine is one row
    per key after a partial aggregate; keys with many rows are on the other side alone.
    """
    on, kinds = list(on), dict(df.dtypes)
    out = spine.select(*on).distinct().join(df.withColumn("_there", F.lit(True)), on, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in (defaults or {}).items()})
    return out.withColumn(present, F.coalesce("_there", F.lit(False))).drop("_there") if present else out.drop("_there")


def backup_freshness(entities: DataFrame, history: DataFrame, key: str, ts: str,
                     since: Column, cols: Sequence[str], tag: str = "kind") -> DataFrame:
    """History rows since ``since`` plus one ``missing`` row per entity without any."""
    recent = history.filter(col(ts) >= since)
    hist = recent.select(F.col(key), *[col(c) for c in cols], F.lit("history").alias(tag))
    missing = (entities.select(key).join(recent.select(key), key, "left_anti")
               .select(F.col(key), *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in cols],
                       F.lit("missing").alias(tag)))
    return hist.unionByName(missing)


def duplicate_index(index_cols: DataFrame, table: Sequence[str], index: str, position: str,
                    column: str, mode: str = "shared_position") -> DataFrame:
    """Indexes sharing a (position, column) with another index of the same table.

    One row per (table, position, column, index) in a shared slot with
    ``n_sharing`` = indexes in that slot and the slot's ``first_index`` /
    ``last_index`` (so every index sees its partners' range). One partial
    aggregation per slot joined back to the members: linear, whereas the pair
    list is quadratic in a hot slot.

    ``mode="exact_list"`` is the stricter reading: indexes whose whole column
    lists are identical (same fingerprint and width), one row per index with
    the size and range of its identical group.
    """
    if mode == "exact_list":
        fp = index_fingerprints(index_cols, table, index, position, column)
        full = fp.filter(F.col("_k") == F.col("_width")).select(*table, index, F.col("_width").alias("width"),
                                                                F.col("_fp").alias("_list"))
        grp = list(table) + ["width", "_list"]
        agg = (full.groupBy(*grp).agg(F.count("*").alias("n_sharing"), F.min(index).alias("first_index"),
                                      F.max(index).alias("last_index"))
                   .filter(F.col("n_sharing") > 1))
        return full.join(agg, grp).drop("_list")
    slot = list(table) + [position, column]
    members = index_cols.select(*slot, index).dropna().distinct()
    agg = (members.groupBy(*slot).agg(F.count("*").alias("n_sharing"), F.min(index).alias("first_index"),
                                      F.max(index).alias("last_index"))
                  .filter(F.col("n_sharing") > 1))
    return members.join(agg, slot)


def blocked_prefix(rows: DataFrame, key: Sequence[str], order: str, value: Column | None, out: str,
                   block: int = 1024, total: str | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (a running count when None) along
    ``order`` within ``key`` — without putting a whole key in one task.

    ``order`` is a unique integer within a key. Rows are cut into blocks of
    ``block`` consecutive order values; per-(key, block) totals come from a
    partial aggregation, their exclusive prefix is a window over the block
    summaries only (n/block rows per key), and the in-block running sum is a
    window over at most ``block`` rows. A key holding a third of the data is
    spread over its blocks. ``total``: also attach the key's grand total
    (from the same block-summary window, no extra join).
    """
    key = list(key)
    v = F.lit(1).cast("bigint") if value is None else value
    keep = "_blk" in rows.columns  # chained scans reuse the block column (and its partitioning)
    r = (rows if keep else rows.withColumn("_blk", F.floor(col(order) / block))).withColumn("_v", v)
    tot = r.groupBy(*key, "_blk").agg(F.sum("_v").alias("_bt"))
    wb = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.withColumn("_bp", F.coalesce(F.sum("_bt").over(wb), F.lit(0).cast(tot.schema["_bt"].dataType)))
    if total:
        pre = pre.withColumn(total, F.sum("_bt").over(Window.partitionBy(*key)))
    pre = pre.drop("_bt")
    wi = Window.partitionBy(*key, "_blk").orderBy(col(order)).rowsBetween(Window.unboundedPreceding, 0)
    out_df = (r.join(pre, [*key, "_blk"])
               .withColumn(out, F.col("_bp") + F.sum("_v").over(wi))
               .drop("_v", "_bp"))
    return out_df if keep else out_df.drop("_blk")


def index_fingerprints(index_cols: DataFrame, table: Sequence[str], index: str, position: str,
                       column: str, block: int | None = None) -> DataFrame:
    """Per index position k: fingerprint of columns 1..k and the index width.

    k = rank of the position within the index; fingerprint = running DECIMAL
    sum of xxhash64(k, column): order-sensitive and exact (no wraparound).
    ``block=None``: one streaming window per index — right when a list is
    bounded (catalog indexes: the DBMS limits key columns to a few dozen).
    ``block=n``: both running sums use ``blocked_prefix``, so a list of any
    length (a hot key) is split across tasks; positions must then be unique
    integers within an index.
    """
    key = list(table) + [index]
    if block is None:
        w = Window.partitionBy(*key).orderBy(col(position))
        return (index_cols
                .withColumn("_k", F.row_number().over(w))
                .withColumn("_h", F.xxhash64(F.col("_k"), col(column)).cast("decimal(38,0)"))
                .withColumn("_fp", F.sum("_h").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .withColumn("_width", F.count("*").over(Window.partitionBy(*key))))
    blk = index_cols.withColumn("_blk", F.floor(col(position) / block))
    ranked = blocked_prefix(blk, key, position, None, "_k", block, total="_width")
    hashed = ranked.withColumn("_h", F.xxhash64(F.col("_k").cast("int"), col(column)).cast("decimal(38,0)"))
    return blocked_prefix(hashed, key, position, F.col("_h"), "_fp", block).drop("_blk")


def redundant_index(index_cols: DataFrame, table: Sequence[str], index: str, position: str,
                    column: str, block: int | None = None) -> DataFrame:
    """Indexes whose column list is a strict prefix of another index's list.

    One row per redundant index A: ``width``, ``n_covering`` = indexes B of
    the same table whose first width(A) columns equal A's and that are
    longer, ``first_covering`` = the smallest such B. Array-prefix semantics
    (``(a)`` is not a prefix of ``(ab,c)``). B's prefixes are keyed by
    (table, k, fingerprint) and counted *before* the join, so each A meets
    exactly one aggregated row whatever the skew. The fingerprint is a sum of
    64-bit position-salted hashes (false match odds ~ m^2 / 2^64). ``block``:
    see ``index_fingerprints`` (set it when column lists are unbounded).
    """
    table = list(table)
    fp = index_fingerprints(index_cols, table, index, position, column, block)
    full = (fp.filter(F.col("_k") == F.col("_width"))
            .select(*table, index, F.col("_width").alias("width"), F.col("_fp").alias("fp")))
    cov = (fp.filter(F.col("_k") < F.col("_width"))
           .groupBy(*table, F.col("_k").alias("width"), F.col("_fp").alias("fp"))
           .agg(F.count("*").alias("n_covering"), F.min(col(index)).alias("first_covering")))
    return full.join(cov, table + ["width", "fp"]).drop("fp")


def blocking_pairs(locks: DataFrame, key_cols: Sequence[str], pid: str, granted: Column,
                   extra: Sequence[str] = ()) -> DataFrame:
    """Waiters on a lock key that other sessions hold (null-safe key equality).

    One row per waiter: ``n_holders`` (holders with another pid) and
    ``first_holder`` (smallest such pid). A key is one struct, whose NULL parts
    are equal like ``IS NOT DISTINCT FROM``, so every step deals rows by the same
    column. Per key the holders are counted and the two smallest kept (a group
    limit before the shuffle); a waiter that holds the key too takes the second.
    """
    from pyspark.sql import Window
    keys = list(key_cols)
    locks = locks.withColumn("_k", F.struct(*keys))
    holders = locks.filter(granted).select("_k", col(pid).alias("_hp")).distinct()
    rank = F.row_number().over(Window.partitionBy("_k").orderBy(F.col("_hp").asc_nulls_last()))
    first = (holders.withColumn("_r", rank).filter(F.col("_r") <= 2).groupBy("_k")
             .agg(F.min(F.when(F.col("_r") == 1, F.col("_hp"))).alias("_h1"), F.min(F.when(F.col("_r") == 2, F.col("_hp"))).alias("_h2")))
    held = first.join(holders.groupBy("_k").agg(F.count("*").alias("_hn")), "_k")
    j = locks.filter(~granted).select("_k", *keys, col(pid).alias("waiter"), *extra).join(held, "_k")
    j = j.join(holders.withColumnRenamed("_hp", "waiter").withColumn("_too", F.lit(1)), ["_k", "waiter"], "left")
    return (j.withColumn("n_holders", F.col("_hn") - F.coalesce("_too", F.lit(0)))
             .withColumn("first_holder", F.when(F.col("_h1") == F.col("waiter"), F.col("_h2")).otherwise(F.col("_h1")))
             .filter(F.col("n_holders") > 0)
             .select(*keys, "waiter", *extra, "n_holders", "first_holder"))


def blocking_parent(requests: DataFrame, id_col: str, parent_col: str, cols: Sequence[str],
                    how: str = "left", prefix: str = "blocker_") -> DataFrame:
    """``blocked.parent = blocker.id`` self-join; blocker columns prefixed."""
    blocker = requests.select(col(id_col).alias("_bid"), *[col(c).alias(prefix + c) for c in cols])
    return requests.join(blocker, col(parent_col) == F.col("_bid"), how).drop("_bid")


def tagged_union(frames: dict, tag: str = "tag") -> DataFrame:
    """Union catalogs with a type tag (``UNION ALL 'TABLE' ... 'INDEX'``)."""
    out = None
    for t, df in frames.items():
        d = df.withColumn(tag, F.lit(t))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def name_ioc(df: DataFrame, name_col: str, patterns: Sequence[tuple[str, str]],
             out: str = "pattern") -> DataFrame:
    """Rows whose name matches any of a fixed list of LIKE patterns; one row
    per (row, matching pattern). A projection + generator, no join."""
    hits = F.array(*[F.when(col(name_col).like(p), F.lit(label)) for label, p in patterns])
    return (df.withColumn("_hits", F.filter(hits, lambda x: x.isNotNull()))
              .filter(F.size("_hits") > 0)
              .withColumn(out, F.explode("_hits")).drop("_hits"))


def apply_rows(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], cols: dict[str, str],
               order: Sequence[Column] = (), n: int | None = None, outer: bool = False) -> DataFrame:
    """``CROSS APPLY`` / ``OUTER APPLY``: the right rows that belong to each left row, as a lateral join.

    on: (left column, right column) pairs of the correlation; cols: output name -> right column. With ``n`` only the
    first ``n`` right rows of each left row in ``order`` (``SELECT TOP n ... ORDER BY``); add a unique tie-break.
    Left rows without right rows go, or are kept with NULLs (``outer``). The correlated limit becomes a rank over the
    correlation's columns with a group limit before its shuffle, so a left row with many right rows costs n of each task.
    """
    inner = right.alias("_r").where(F.lit(True))
    for a, b in on:
        inner = inner.where(F.col(f"_r.{b}") == F.col(f"_l.{a}").outer())
    if n is not None:
        inner = inner.orderBy(*order).limit(n)
    return left.alias("_l").lateralJoin(inner.select(*[F.col(f"_r.{c}").alias(name) for name, c in cols.items()]),
                                        how="left" if outer else "inner")


def longest_prefix_join(df: DataFrame, text, limits: DataFrame, prefix: str, cols: Sequence[str]) -> DataFrame:
    """Each row with the ``cols`` of the longest ``prefix`` in a table of limits that its text begins with; NULL without one.

    An equi join on the beginnings of the lengths that occur in the table (``LIKE concat(prefix, '%')`` is no equality,
    and would meet every limit). Every distinct text is looked up once, and one aggregate keeps its longest match, so
    neither a frequent text nor a table of any size makes pairs. Of equal prefixes the smallest ``cols`` are taken.
    """
    cols = list(cols)
    lengths = [r[0] for r in limits.select(F.length(prefix)).distinct().dropna().collect()]  # no more than the longest prefix is long
    if not lengths:
        kinds = dict(limits.dtypes)
        return df.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in (prefix, *cols)])
    one = limits.filter(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("_p")).agg(F.min(F.struct(*cols)).alias("_v"))
    texts = df.select(col(text).alias("_t")).distinct()
    begins = F.transform(F.filter(F.array(*[F.lit(k) for k in sorted(lengths)]), lambda k: k <= F.length("_t")),
                         lambda k: F.substring("_t", F.lit(1), k))
    found = (texts.select("_t", F.explode(begins).alias("_p")).join(one, "_p")
             .groupBy("_t").agg(F.max_by(F.struct("_p", "_v"), F.length("_p")).alias("_m")))
    out = df.withColumn("_text", col(text)).join(found, F.col("_text") == F.col("_t"), "left")
    return out.select(*[F.col(c) for c in df.columns], F.col("_m._p").alias(prefix), *[F.col(f"_m._v.{c}").alias(c) for c in cols])


def type_limit_usage(df: DataFrame, type_col, value_col, limits: Sequence[tuple] | DataFrame,
                     digits: int = 2, red: float | None = 80.0) -> DataFrame:
    """Percent of a type's maximum: longest matching type prefix wins; a type
    string containing ``unsigned`` uses the unsigned maximum.

    limits: (prefix, signed_max, unsigned_max) — a fixed, small type catalog,
    so matching is a CASE chain (no join) — or a table of these three columns,
    joined by ``longest_prefix_join``.
    """
    if isinstance(limits, DataFrame):
        table = limits.select(F.lower("prefix").alias("type_prefix"), F.col("signed_max").cast("decimal(20,0)").alias("_s"),
                              F.coalesce("unsigned_max", "signed_max").cast("decimal(20,0)").alias("_u"))
        out = longest_prefix_join(df, F.lower(col(type_col)), table, "type_prefix", ["_s", "_u"])
        out = out.withColumn("type_max", F.when(F.lower(col(type_col)).contains("unsigned"), F.col("_u")).otherwise(F.col("_s"))).drop("_s", "_u")
        return _of_maximum(out, value_col, digits, red)
    pref = longest_prefix(F.lower(col(type_col)), [p.lower() for p, *_ in limits])
    smax = F.create_map(*[x for p, s, u in limits for x in (F.lit(p.lower()), F.lit(str(s)))])
    umax = F.create_map(*[x for p, s, u in limits for x in (F.lit(p.lower()), F.lit(str(u if u is not None else s)))])
    unsigned = F.lower(col(type_col)).contains("unsigned")
    mx = F.when(unsigned, F.element_at(umax, pref)).otherwise(F.element_at(smax, pref)).cast("decimal(20,0)")
    return _of_maximum(df.withColumn("type_prefix", pref).withColumn("type_max", mx), value_col, digits, red)


def _of_maximum(df: DataFrame, value_col, digits: int, red: float | None) -> DataFrame:
    out = df.withColumn("pct_of_max", fround(F.lit(100.0) * col(value_col).cast("double") / nz(F.col("type_max").cast("double")), digits))
    if red is not None:
        out = out.withColumn("is_abnormal", flag(F.col("pct_of_max") > red))
    return out
