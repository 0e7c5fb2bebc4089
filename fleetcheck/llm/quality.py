"""Quality rules with adaptive thresholds, DataFrame functions only.

Each document gets whole-text metrics. Per language and source, each metric is summed into a mergeable quantile
sketch: a histogram over integer buckets of five leading bits (relative error at most 1/16, exact below 32), so
sketches of parts add up to the sketch of the whole. A threshold is ``median + 4 * (median - p10) + slack`` (for a
low fence, mirrored with p90), so a group in which most documents are alike loses none of them, and up to half a
group may be bad without moving its fence much. Groups under ``MIN_GROUP`` rows take the merged sketch of their
language, then that of all rows.

Defined results: null text counts as empty; empty texts, and texts under 50 words, fail the base rule; null
languages and sources form groups of their own; repeated rows are judged each; an empty table gives an empty one.
Added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, free_name, stored, together

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_GROUP = 200
MAX_BROADCAST = 200_000  # rows of thresholds, of at most a few hundred bytes; beyond it the join is left to Spark
#: name -> (numerator, denominator, scale, slack, side); values are integers scaled by the third entry
RULES = {
    "sym": ("n_symbols", "n_words", 1000, 100, "high"),
    "rep": ("n_repeat_words", "n_words", 1000, 250, "high"),
    "dup": ("n_dup_lines", "n_lines", 1000, 500, "high"),
    "long": ("word_chars", "n_words", 100, 300, "high"),
    "short": ("word_chars", "n_words", 100, 200, "low"),
}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of METRICS (long) and base_failed."""
    keep = [c for c in docs.columns if c not in METRICS and c not in ("base_failed", "kept")]
    d = apart(docs, [*keep, text])
    d = d.withColumnRenamed(f"c{len(keep)}", "_t").withColumn("_t", F.coalesce("_t", F.lit("")))
    d = d.withColumn("_w", F.split(F.btrim("_t", F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    d = d.withColumn("_w", F.when(F.translate("_t", BLANKS, "") == "", F.array().cast("array<string>")).otherwise(F.col("_w")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    gram = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    d = d.withColumn("_g", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), gram))
                     .otherwise(F.array().cast("array<bigint>")))
    # Windows in order of value, then of place; only texts with a repeated window need the sort.
    d = d.withColumn("_p", F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(None)).otherwise(
        F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_p", j)["g"] == x["g"], F.lit(False))
    d = d.withColumn("_r", F.sort_array(F.transform(F.filter("_p", lambda x, i: same(x, i - 1) | same(x, i + 1)),
                                                    lambda x: x["i"])))
    # A window covers its three words, or as many as lie before the next repeated window.
    cover = F.aggregate(F.transform("_r", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - p, F.lit(3)))),
                        F.lit(0), lambda a, x: a + x)
    d = d.select(
        *[f"c{i}" for i in range(len(keep))],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(*together(keep), *METRICS, "base_failed")


def _value(rule: str) -> Column:
    top, below, scale, _, _ = RULES[rule]
    return F.expr(f"({scale} * {top}) div greatest({below}, 1)")


def _bucket(v: Column) -> Column:
    """v without all but its five leading bits."""
    low = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): one mergeable histogram for each group and rule, of rows that pass the base rule."""
    rows = measured.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), _bucket(_value(r)).alias("bucket")) for r in RULES])).alias("x"))
    return rows.groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, rule, fence) from sketches, merging those of small groups upwards."""
    def quantiles(keys):
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "rule")
        merged = merged.withColumn("total", F.sum("n").over(w)).withColumn(
            "upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
        return merged.groupBy(*keys, "rule").agg(F.max("total").alias("total"), at(10).alias("p10"), at(50).alias("p50"),
                                                  at(90).alias("p90"))

    slack = F.create_map(*[x for r, v in RULES.items() for x in (F.lit(r), F.lit(v[3]))])[F.col("rule")]
    low = F.col("rule").isin([r for r, v in RULES.items() if v[4] == "low"])
    fence = F.when(low, F.col("p50") - 4 * (F.col("p90") - F.col("p50")) - slack).otherwise(
        F.col("p50") + 4 * (F.col("p50") - F.col("p10")) + slack)
    level = lambda keys, name: quantiles(keys).select(*keys, "rule", "total", fence.cast("long").alias(name))
    own = level(["lang", "source"], "own").withColumnRenamed("total", "own_n").alias("a")
    lang = level(["lang"], "by_lang").withColumnRenamed("total", "lang_n").alias("b")
    every = level([], "by_all").drop("total").alias("c")
    same = lambda x, y, c: F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}"))
    joined = own.join(lang, same("a", "b", "lang") & same("a", "b", "rule")).join(every, same("a", "c", "rule"))
    chosen = F.when(F.col("own_n") >= MIN_GROUP, F.col("own")).when(
        F.col("lang_n") >= MIN_GROUP, F.col("by_lang")).otherwise(F.col("by_all"))
    return joined.select("a.lang", "a.source", "a.rule", chosen.alias("fence"))


def apply_rules(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with METRICS, base_failed and kept. The metrics are computed once and written to the shared folder.

    The thresholds (one row for each language and source) are counted and, when few, joined back by a broadcast, so
    the documents don't move.
    """
    measured = metrics(docs)
    if not with_text:
        measured = measured.drop("text")
    measured = stored(measured, "quality")
    fences = thresholds(sketches(measured)).groupBy("lang", "source").agg(
        F.struct(*[F.max(F.when(F.col("rule") == r, F.col("fence"))).alias(r) for r in RULES]).alias("rules"))
    name = free_name(measured.columns, "fence")  # a row's thresholds are one column, of a name that the documents don't have
    fences = stored(fences.select(F.struct("lang", "source", "rules").alias(name)), "fences")
    if fences.count() <= MAX_BROADCAST:
        fences = F.broadcast(fences)
    inside = F.lit(True)
    for r, (_, _, _, _, side) in RULES.items():
        fence = F.col(f"{name}.rules.{r}")
        ok = _value(r) >= fence if side == "low" else _value(r) <= fence
        inside = inside & F.coalesce(ok, F.lit(True))
    out = measured.join(fences, F.col("lang").eqNullSafe(F.col(f"{name}.lang")) & F.col("source").eqNullSafe(F.col(f"{name}.source")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop(name)


_SQL_RULES = " union all ".join(
    f"select doc_id, lang, source, '{r}' as rule, ({s} * {a}) // greatest({b}, 1) as v, {k} as slack, {1 if side == 'low' else 0} as low "
    f"from m where not base_failed" for r, (a, b, s, k, side) in RULES.items())

SQL = rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
g as (select rid, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c
      from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from g) where n > 1),
cov as (select rid, count(distinct i + k) as n from r, (select unnest([0, 1, 2]) as k) group by rid),
li as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup
       from (select rid, unnest(string_split(text, chr(10))) as line from t)
       where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m0 as (select t.rid, doc_id, lang, source, len(ws)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
         coalesce(n_lines, 0)::bigint as n_lines
       from t join w using (rid) left join cov using (rid) left join li using (rid)),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m0),
v as ({_SQL_RULES}),
b as (select lang, source, rule, slack, low,
        (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as bucket, count(*) as n
      from v group by all),
lv as (select 3 as lv, lang, source, rule, slack, low, bucket, n from b
       union all select 2, lang, null, rule, slack, low, bucket, sum(n) from b group by all
       union all select 1, null, null, rule, slack, low, bucket, sum(n) from b group by all),
cu as (select *, sum(n) over (partition by lv, lang, source, rule) as total,
         sum(n) over (partition by lv, lang, source, rule order by bucket rows unbounded preceding) as upto from lv),
q as (select lv, lang, source, rule, slack, low, max(total) as total, min(bucket) filter (100 * upto >= 10 * total) as p10,
        min(bucket) filter (100 * upto >= 50 * total) as p50, min(bucket) filter (100 * upto >= 90 * total) as p90
      from cu group by all),
f as (select *, case when low = 1 then p50 - 4 * (p90 - p50) - slack else p50 + 4 * (p50 - p10) + slack end as fence from q),
h as (select a.lang, a.source, a.rule,
        case when a.total >= {MIN_GROUP} then a.fence when l.total >= {MIN_GROUP} then l.fence else e.fence end as fence
      from f a join f l on l.lv = 2 and l.lang is not distinct from a.lang and l.rule = a.rule
      join f e on e.lv = 1 and e.rule = a.rule where a.lv = 3),
bad as (select distinct m.rid from m join h on h.lang is not distinct from m.lang and h.source is not distinct from m.source
        where {' or '.join(f"(h.rule = '{r}' and ({s} * {a}) // greatest({b}, 1) {'<' if side == 'low' else '>'} h.fence)" for r, (a, b, s, k, side) in RULES.items())})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rid not in (select rid from bad) as kept from m
"""
