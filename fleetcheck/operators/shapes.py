"""Aggregation shapes: conditional pivots, grouping sets, rollups, ordered
string aggregates, zero-filled object matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import col


def conditional_pivot(df: DataFrame, keys: Sequence[str], pivot: str, values: dict,
                      agg: str = "count", value: str | None = None, cast: str | None = None) -> DataFrame:
    """One row per key, one column per pivot value, in a single aggregation.

    ``values`` maps output column -> pivot value. Explicit values mean no
    extra job to discover them and one partial/final aggregate pair.
    """
    cols = []
    for out, v in values.items():
        hit = col(pivot) == F.lit(v)
        if agg == "count":
            e = F.count_if(hit)
        elif agg == "sum":
            e = F.sum(F.when(hit, col(value)))
        elif agg == "max":
            e = F.max(F.when(hit, col(value)))
        elif agg == "avg":
            e = F.avg(F.when(hit, col(value)))
        else:
            raise ValueError(agg)
        cols.append((e.cast(cast) if cast else e).alias(out))
    return df.groupBy(*keys).agg(*cols)


def group_total_sets(df: DataFrame, keys: Sequence[str], aggs: Sequence, labels: dict | None = None,
                     outer: Sequence[str] = ()) -> DataFrame:
    """``GROUPING SETS ((outer, keys...), (outer))``: detail rows plus one total
    row per ``outer`` key (the grand total when ``outer`` is empty); key columns
    of the total row get ``labels[key]`` (via ``grouping()``, so a real NULL key
    stays NULL)."""
    keys, outer = list(keys), list(outer)
    out = df.groupingSets([outer + keys, outer], *outer, *keys).agg(
        *aggs, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    for k in keys:
        lab = (labels or {}).get(k)
        if lab is not None:
            out = out.withColumn(k, F.when(F.col(f"_g_{k}") == 1, F.lit(lab)).otherwise(F.col(k).cast("string")))
    return out.drop(*[f"_g_{k}" for k in keys])


def rollup_total(df: DataFrame, outer: Sequence[str], inner: str, aggs: Sequence,
                 label: str = "SUM") -> DataFrame:
    """``GROUP BY outer, ROLLUP(inner)``: a subtotal row per outer key with
    ``inner`` labelled ``label``."""
    outer = list(outer)
    sets = [outer + [inner], outer]
    out = df.groupingSets(sets, *outer, inner).agg(*aggs, F.grouping(inner).alias("_g"))
    return (out.withColumn(inner, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(inner).cast("string")))
               .drop("_g"))


def nested_rollup(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], merge: dict | None = None) -> DataFrame:
    """A line for each value of a nested key (instance, container, node) at every level: of an instance, of each of its
    containers, of each of their nodes. (keys..., level, aggs...): inner keys of an outer line are NULL, ``level`` tells them
    from NULL keys (the number of keys that hold).

    aggs are sums and counts; ``merge`` names another function for those that are merged otherwise ("max", "min"). Rows
    are first reduced to the innermost lines, so the expansion to levels is of these and not of the rows.
    """
    keys, merge = list(keys), merge or {}
    inner = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    sets = [keys[:k] for k in range(len(keys), 0, -1)]
    out = inner.groupingSets(sets, *keys).agg(*[getattr(F, merge.get(n, "sum"))(n).alias(n) for n in aggs],
                                              *[F.grouping(k).cast("int").alias(f"_g_{k}") for k in keys])
    level = sum((1 - F.col(f"_g_{k}") for k in keys), F.lit(0))
    return out.withColumn("level", level).select(*keys, "level", *aggs)


def ordered_concat(df: DataFrame, key: Sequence[str], val: str, order: str | None = None,
                   sep: str = ",", distinct: bool = False, out: str = "items") -> DataFrame:
    """Deterministic string aggregate (LISTAGG / GROUP_CONCAT / WM_CONCAT).

    For bounded-cardinality values (host names, segments, roles): with
    ``distinct`` the (key, value) pairs are de-duplicated by a partial
    aggregate first, so a hot key ships only its distinct values.
    """
    key = list(key)
    if distinct:
        if order and order != val:
            df = df.groupBy(*key, val).agg(F.min(order).alias(order))
        else:
            df = df.select(*key, val).distinct()
    if order is None or order == val:
        agg = F.array_join(F.sort_array(F.collect_list(col(val).cast("string"))), sep)
    else:
        arr = F.sort_array(F.collect_list(F.struct(col(order).alias("o"), col(val).cast("string").alias("v"))))
        agg = F.array_join(F.transform(arr, lambda s: s["v"]), sep)
    return df.groupBy(*key).agg(agg.alias(out))


def object_matrix(entities: DataFrame, key: Sequence[str], parts: dict) -> DataFrame:
    """Counts per entity from several object sources, zero-filled, all
    entities kept. ``parts`` maps output column -> (DataFrame, filter or None)
    whose rows carry ``key``. Each source is pre-aggregated to one row per
    key before the left join."""
    key = list(key)
    out = entities
    for name, (src, cond) in parts.items():
        s = src.filter(cond) if cond is not None else src
        c = s.groupBy(*key).agg(F.count("*").alias(name))
        out = out.join(c, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))
    return out
