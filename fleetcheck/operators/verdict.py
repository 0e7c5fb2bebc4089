"""Verdict core: flags, utilization, code decoding, configuration audit.

All of these are projections (no shuffle) except ``config_audit``, which
joins the settings to a rule table that is a fixed literal list (bounded
size, so it is broadcast) and, for reference rules, to the settings of the
same instance (an equi-join on the instance key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, compare, flag, label_map, pct, safe_div, fround

RULE_SCHEMA = "name string, kind string, expected string, ref_name string, factor double, advice string"


def threshold_flag(df: DataFrame, metric, limit, op: str = ">", when: Column | None = None,
                   out: str = "is_abnormal") -> DataFrame:
    """Add ``is_abnormal = metric <op> limit`` (and ``when``); NULL metric -> False."""
    cond = compare(metric, op, limit)
    if when is not None:
        cond = cond & when
    return df.withColumn(out, flag(cond))


def utilization_pct(df: DataFrame, used, limit, digits: int = 2, out: str = "pct",
                    red: float | None = None, op: str = ">=") -> DataFrame:
    """``round(100*used/nullif(limit,0), digits)``; NULL/0 limit = unlimited -> NULL."""
    df = df.withColumn(out, pct(used, limit, digits))
    if red is not None:
        df = threshold_flag(df, out, red, op)
    return df


def parse_limit(c) -> Column:
    """Resource limit text -> DOUBLE: ``UNLIMITED`` / 0 / blank -> NULL."""
    v = F.trim(col(c).cast("string"))
    n = v.try_cast("double")
    return F.when(F.upper(v) == "UNLIMITED", F.lit(None).cast("double")).when(n == 0, F.lit(None).cast("double")).otherwise(n)


def status_decode(df: DataFrame, c, mapping: Sequence[tuple], bad: Sequence | None = None,
                  good: Sequence | None = None, label_col: str = "status_label",
                  default=None) -> DataFrame:
    """Code -> label via a fixed list, plus ``is_abnormal`` for bad (or not-good) codes."""
    df = df.withColumn(label_col, label_map(c, mapping, default))
    if bad is not None:
        cond = col(c).isin(list(bad))
    elif good is not None:
        cond = ~col(c).isin(list(good))
    else:
        cond = F.lit(False)
    return df.withColumn("is_abnormal", flag(cond))


def fragmentation_class(df: DataFrame, pct_col, pages_col, rebuild: float = 30.0,
                        reorganize: float = 10.0, min_pages: float = 1000,
                        out: str = "action", red: Sequence[str] = ("REBUILD", "REORGANIZE")) -> DataFrame:
    """OK / REORGANIZE / REBUILD ladder (strict ``>`` on both bounds); ``red`` names the abnormal actions."""
    p, n = col(pct_col), col(pages_col)
    act = (F.when((p > rebuild) & (n > min_pages), F.lit("REBUILD"))
           .when((p > reorganize) & (n > min_pages), F.lit("REORGANIZE"))
           .otherwise(F.lit("OK")))
    return df.withColumn(out, act).withColumn("is_abnormal", F.coalesce(F.col(out).isin(list(red)), F.lit(False)))


def latency_per_op(df: DataFrame, stall, ops, out: str = "avg_latency", digits: int = 2,
                   red: float | None = None) -> DataFrame:
    """stall / ops, 0 when there are no operations; decimal division for both
    display and verdict."""
    v = F.when(F.coalesce(col(ops), F.lit(0)) == 0, F.lit(0.0)).otherwise(safe_div(stall, ops))
    df = df.withColumn(out, fround(v, digits))
    if red is not None:
        df = threshold_flag(df, out, red, ">")
    return df


def impact_score(df: DataFrame, factors: Sequence, out: str = "impact", digits: int = 2) -> DataFrame:
    v = None
    for f in factors:
        v = col(f).cast("double") if v is None else v * col(f).cast("double")
    return df.withColumn(out, fround(v, digits))


def role_matrix(df: DataFrame, flags: dict, unexpected: Column | None = None,
                yes: str = "YES", no: str = "no") -> DataFrame:
    """Boolean/0-1 privilege columns -> labels; ``unexpected`` marks red rows."""
    for src, dst in flags.items():
        c = col(src)
        truth = c if dict(df.dtypes).get(src) == "boolean" else (c != 0)
        df = df.withColumn(dst, F.when(truth, F.lit(yes)).otherwise(F.lit(no)))
    return df.withColumn("is_abnormal", flag(unexpected) if unexpected is not None else F.lit(False))


def host_port_split(df: DataFrame, c, host: str = "host", port: str = "port",
                    default_port=None) -> DataFrame:
    from ..functions import split_host_port
    h, p = split_host_port(c, default_port)
    return df.withColumn(host, h).withColumn(port, p)


def settings_select(settings: DataFrame, names: Sequence[str], name_col: str = "name",
                    value_col: str = "value", unit_col: str | None = None,
                    out: str = "display_value", blank: str | None = None) -> DataFrame:
    """Allow-listed settings; value with unit suffix; blank -> ``blank`` label."""
    df = settings.filter(col(name_col).isin(list(names)))
    v = col(value_col).cast("string")
    if blank is not None:
        v = F.when(F.trim(F.coalesce(v, F.lit(""))) == "", F.lit(blank)).otherwise(v)
    if unit_col is not None:
        v = F.concat_ws(" ", v, col(unit_col))
    return df.withColumn(out, v)


def rules_frame(spark, rules: Sequence[tuple]) -> DataFrame:
    """Literal rule rows ``(name, kind, expected, ref_name, factor, advice)``."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _violates(kind: Column, value: Column, threshold_num: Column, threshold_str: Column) -> Column:
    num = value.cast("string").try_cast("double")
    txt_eq = F.lower(F.trim(value.cast("string"))) == F.lower(F.trim(threshold_str))
    both_num = num.isNotNull() & threshold_num.isNotNull()
    return (F.when(kind == "lt", num < threshold_num)
            .when(kind == "le", num <= threshold_num)
            .when(kind == "gt", num > threshold_num)
            .when(kind == "ge", num >= threshold_num)
            .when(kind == "eq", F.when(both_num, num == threshold_num).otherwise(txt_eq))
            .when(kind == "ne", F.when(both_num, num != threshold_num).otherwise(~txt_eq))
            .when(kind == "is_null", value.isNull() | (F.trim(value.cast("string")) == ""))
            .when(kind == "not_null", value.isNotNull() & (F.trim(value.cast("string")) != ""))
            .otherwise(F.lit(False)))


def config_audit(settings: DataFrame, rules: DataFrame, keys: Sequence[str] = (),
                 name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Join settings to audit rules and evaluate each rule.

    A rule names the *abnormal* condition: ``kind`` in lt/le/gt/ge/eq/ne/
    is_null/not_null against ``expected``; when ``ref_name`` is set the
    threshold is ``factor`` x the value of that other setting of the same
    instance (e.g. parallel_max_servers > 4 x cpu_count).
    Output: settings columns + kind, expected, threshold, is_abnormal, advice.
    """
    keys = list(keys)
    with_refs = True
    if not isinstance(rules, DataFrame):  # literal rule rows: refs known statically
        rows = list(rules)
        with_refs = any(r[3] for r in rows)
        rules = rules_frame(settings.sparkSession, rows)
    r = F.broadcast(rules.withColumnRenamed("name", "_rule_name"))  # literal rule list: bounded
    s = settings.join(r, col(name_col) == F.col("_rule_name"), "inner").drop("_rule_name")
    if with_refs:
        ref = settings.select(*keys, col(name_col).alias("_ref_name"), col(value_col).alias("_ref_value"))
        cond = [F.col("ref_name") == F.col("_ref_name")]
        s = s.alias("s").join(ref.alias("r"), [F.col(f"s.{k}") == F.col(f"r.{k}") for k in keys] + cond, "left")
        s = s.select("s.*", "r._ref_value")
    else:
        s = s.withColumn("_ref_value", F.lit(None).cast("string"))
    exp_num = F.col("expected").try_cast("double")
    threshold = F.when(F.col("ref_name").isNotNull(),
                       F.col("_ref_value").try_cast("double") * F.coalesce(F.col("factor"), F.lit(1.0))
                       ).otherwise(exp_num * F.coalesce(F.col("factor"), F.lit(1.0)))
    s = s.withColumn("threshold", threshold)
    s = s.withColumn("is_abnormal", flag(_violates(F.col("kind"), col(value_col), F.col("threshold"), F.col("expected"))))
    return s.drop("_ref_value", "ref_name", "factor")


def status_wide(status: DataFrame, keys: Sequence[str], names: dict, name_col: str = "name",
                value_col: str = "value", cast: str = "double") -> DataFrame:
    """Key/value status rows -> one typed row per instance in ONE scan.

    ``names`` maps output column -> status name. Conditional aggregation, so
    the source is read once for all keys (the reference looks each up with a
    separate scalar query).
    """
    aggs = [F.max(F.when(col(name_col) == n, col(value_col))).try_cast(cast).alias(alias)
            for alias, n in names.items()]
    return status.filter(col(name_col).isin(list(names.values()))).groupBy(*keys).agg(*aggs)
