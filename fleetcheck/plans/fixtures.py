"""Fixture queries: every operator run on the driver's tables.

Each query calls the same operator function a catalog check calls, with the
fixture's column names playing the catalog's roles (SURVEY §7.3). Every
query reads whole tables. Output hygiene for the DuckDB comparison: money is
summed as DECIMAL (exact), ratios use ``fround`` (same IEEE steps in both
engines), computed integers are BIGINT except integer columns that can hold
NULLs, which are DOUBLE (pandas turns them into float64 + NaN in Spark but
nullable Int64 in DuckDB), dates are ``yyyy-MM-dd`` strings.

Roles on ``events``: instance = ``user_id % 3``, snapshot = day of ``ts``
(snap_id = days since 2024-01-01, startup epoch = snap_id div 10), statistic
= ``event_type``, cumulative counter = running count of events per
(instance, statistic) at day end, zero-filled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_of_lit, day_str, fround, nz, safe_div
from ..operators import capacity as cap
from ..operators import findings as fnd
from ..operators import perf, ranking, relations, sections, shapes, text, time, verdict
from ..session import ensure_checkpoint_dir
from ..sources import Tables, read_snapshots, write_snapshots
from ..sources.store import Views, collections, newest_collections

# As-of instants of the fixture tables and the statistic names.
EV_AS_OF = "2024-01-31 00:00:00"
ORD_AS_OF = "2001-08-02 00:00:00"
EPOCH_DAY = "2024-01-01"
STATS = ("click", "error", "purchase", "signup", "view")
DAY_S = 86400

BIG = "bigint"
DBL = "double"


def _ev(t: Tables) -> DataFrame:
    return t.events.withColumn("instance_id", F.col("user_id") % 3)


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative per-(instance, stat) counters at each day end, zero-filled.

    Events are read once: one row per instance and day counts every stat, the running
    totals go over an instance's days, and a day holds until the next one with events.
    """
    from pyspark.sql import Window
    ev = _ev(Tables(spark, d)).select("instance_id", F.to_date("ts").alias("d"), "event_type").filter(F.col("d").isNotNull())
    daily = ev.groupBy("instance_id", "d").agg(*[F.count_if(F.col("event_type") == s).alias(s) for s in STATS])
    w = Window.partitionBy("instance_id").orderBy("d")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("d").over(w), F.date_add("d", 1))
    totals = daily.select("instance_id", "d", until.alias("until"), *[F.sum(s).over(upto).cast(BIG).alias(s) for s in STATS])
    return (totals.select("instance_id", F.explode(F.sequence("d", F.date_sub("until", 1))).alias("d"), *STATS)
                 .select("instance_id", "d", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS])))
                 .withColumn("snap_id", F.datediff("d", F.lit(EPOCH_DAY).cast("date")).cast(BIG))
                 .withColumn("startup", (F.col("snap_id") / 10).cast(BIG)))


# --------------------------------------------------------------- verdict core
def q_hour_matrix(spark, d):
    ev = _ev(Tables(spark, d))
    out = time.hour_matrix(ev, "ts", ["instance_id"], cell_red=10, total_red=120)
    return out.withColumn("red_cells", F.col("red_cells").cast(BIG))


def q_threshold_flag(spark, d):
    s = Tables(spark, d).supplier.select("s_suppkey", "s_name", F.col("s_acctbal").alias("metric"))
    return verdict.threshold_flag(s, "metric", 0.0, "<").withColumn("threshold", F.lit(0.0))


def q_utilization_pct(spark, d):
    p = Tables(spark, d).part.select(
        "p_partkey", F.col("p_size").alias("used"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast(DBL)).otherwise(F.lit(50.0)).alias("limit_value"))
    return verdict.utilization_pct(p, "used", "limit_value", 2, red=90, op=">=")


# Fixture audit rules (segment name, kind, expected, advice).
CONFIG_RULES = [
    ("AUTOMOBILE", "lt", "0", None, None, "balance below zero"),
    ("BUILDING", "gt", "9000", None, None, "balance above 9000"),
    ("FURNITURE", "lt", "-500", None, None, "balance below -500"),
    ("HOUSEHOLD", "ge", "9500", None, None, "balance at or above 9500"),
    ("MACHINERY", "eq", "0", None, None, "balance exactly zero"),
]


def q_config_audit(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.col("c_mktsegment").alias("setting_name"),
                                         F.col("c_acctbal").alias("setting_value"))
    out = verdict.config_audit(c, CONFIG_RULES, name_col="setting_name", value_col="setting_value")
    return out.select("c_custkey", "setting_name", "setting_value", "kind", "expected", "threshold",
                      "is_abnormal", "advice")


# Allow-listed "settings" of the fixture.
SETTINGS_ALLOW = ["NATION_1", "NATION_3", "NATION_5", "NATION_8", "NATION_13", "NATION_17", "NATION_21", "NATION_24"]


def q_settings_select(spark, d):
    t = Tables(spark, d)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = verdict.settings_select(n, SETTINGS_ALLOW, name_col="n_name", value_col="n_name", unit_col="r_name")
    return out.select("n_nationkey", F.col("n_name").alias("name"), "display_value")


def q_status_wide(spark, d):
    status = (_ev(Tables(spark, d)).groupBy("instance_id", F.col("event_type").alias("name"))
              .agg(F.count("*").alias("value")))
    return verdict.status_wide(status, ["instance_id"], {f"n_{s}": s for s in STATS}, cast=BIG)


def q_topn(spark, d):
    o = Tables(spark, d).orders.select("o_orderstatus", "o_orderkey", "o_totalprice")
    out = ranking.topn(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 10, ["o_orderstatus"])
    return out.withColumn("rn", F.col("rn").cast(BIG))


def q_topn_per_group(spark, d):
    p = Tables(spark, d).part.select("p_brand", "p_partkey", "p_retailprice")
    out = ranking.topn_per_group(p, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], 3)
    return out.withColumn("rn", F.col("rn").cast(BIG))


def q_latest_per_key(spark, d):
    t = Tables(spark, d)
    last = ranking.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                                  ["o_orderkey", "o_orderdate", "o_totalprice"])
    out = t.customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.col("o_orderkey").cast(DBL).alias("o_orderkey"),
                      day_str("o_orderdate").alias("last_order_date"), "o_totalprice")


def q_recent_failures(spark, d):
    ev = Tables(spark, d).events.filter(F.col("ts") < as_of_lit(EV_AS_OF))
    since = as_of_lit(EV_AS_OF) - F.expr("INTERVAL 7 DAYS")
    out = ranking.recent_failures(ev, ["user_id"], [F.col("event_id").desc()], 3,
                                  failed=F.col("event_type") == "error", since=since, ts="ts")
    return out.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                      "value", F.col("rnk").cast(BIG).alias("rnk"))


def q_long_running(spark, d):
    o = Tables(spark, d).orders.filter(F.col("o_orderstatus") == "O")
    out = time.long_running(o, "o_orderdate", as_of_lit(ORD_AS_OF), 365 * DAY_S, 1825 * DAY_S)
    return out.select("o_orderkey", "o_custkey", "elapsed_s",
                      F.floor(F.col("elapsed_s") / DAY_S).cast(BIG).alias("age_days"), "is_abnormal")


def q_age_flag(spark, d):
    t = Tables(spark, d)
    last = (t.orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey")
            .agg(F.max("o_orderdate").alias("last_ts")))
    c = t.customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = time.age_flag(c, "last_ts", as_of_lit(ORD_AS_OF), 1000)
    return out.select("c_custkey", day_str("last_ts").alias("last_date"),
                      F.col("age_days").cast(DBL).alias("age_days"), "is_abnormal")


def q_expiry_window(spark, d):
    t = Tables(spark, d)
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    out = time.expiry_window(j, "l_shipdate", "o_orderdate", horizon=30, red=7, min_days=0)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("days_left").cast(BIG).alias("days_left"),
                      "is_abnormal")


# ------------------------------------------------------------ entity relations
def q_blocking_pairs(spark, d):
    locks = Tables(spark, d).events.select(
        "event_id", day_str("ts").alias("day"), "event_type",
        F.expr("nullif(user_id % 10, 0)").alias("lock_key"), (F.col("value") >= 1).alias("granted"))
    out = relations.blocking_pairs(locks, ["day", "event_type", "lock_key"], "event_id", F.col("granted"))
    return out.select("day", "event_type", F.col("lock_key").cast(DBL).alias("lock_key"), "waiter", "n_holders",
                      "first_holder")


def q_blocking_parent(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", "role")
    c = c.withColumn("_parent", F.struct("conv_id", (F.col("turn") - 1).alias("turn"))) \
         .withColumn("_id", F.struct("conv_id", "turn"))
    out = relations.blocking_parent(c, "_id", "_parent", ["turn", "role"])
    return out.select("conv_id", "turn", "role", F.col("blocker_turn").cast(DBL).alias("blocker_turn"), "blocker_role")


def q_missing_related(spark, d):
    t = Tables(spark, d)
    urgent = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return relations.missing_related(t.customer.select("c_custkey", "c_name"), urgent, "c_custkey",
                                     F.col("o_orderpriority") == "1-URGENT")


def q_member_of(spark, d):
    t = Tables(spark, d)
    toxic = t.labels.filter(F.col("toxic") == 1).select("doc_id")
    return relations.member_of(t.documents.select("doc_id", "lang", "source"), toxic, "doc_id")


def q_backup_freshness(spark, d):
    t = Tables(spark, d)
    hist = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    since = as_of_lit(ORD_AS_OF) - F.expr("INTERVAL 90 DAYS")
    out = relations.backup_freshness(t.customer, hist, "c_custkey", "o_orderdate", since,
                                     ["o_orderkey", "o_orderdate"])
    return out.select("c_custkey", F.col("o_orderkey").cast(DBL).alias("o_orderkey"),
                      day_str("o_orderdate").alias("order_date"), "kind")


def q_duplicate_index(spark, d):
    li = Tables(spark, d).lineitem
    return relations.duplicate_index(li, [], "l_orderkey", "l_linenumber", "l_partkey") \
        .select("l_linenumber", "l_partkey", "l_orderkey", "n_sharing", "first_index", "last_index")


def q_redundant_index(spark, d):
    ev = Tables(spark, d).events.select(day_str("ts").alias("day"), "user_id", "event_id", "event_type")
    # a user-day "column list" grows with the data (and may be hot): blocked prefix scan over
    # blocks of 65536 event ids (bounded in-block windows, few block summaries)
    return relations.redundant_index(ev, ["day"], "user_id", "event_id", "event_type", block=65536) \
        .select("day", "user_id", F.col("width").cast(BIG).alias("width"), "n_covering", "first_covering")


# Fixture "type catalog" (prefix, maximum) matched to
# lower(p_type || ' ' || p_name).
TYPE_LIMITS = [
    ("standard", 1500, None), ("standard red", 1200, None),
    ("small", 1000, None), ("small small", 900, None),
    ("large", 2500, None), ("large hot", 2000, None),
    ("economy", 1100, None), ("economy blue", 1000, None),
    ("medium", 1800, None), ("medium old", 1600, None),
    ("promo", 2200, None), ("promo red widget", 1300, None),
]


def q_type_limit_usage(spark, d):
    p = Tables(spark, d).part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("type_name"),
                                     "p_retailprice")
    out = relations.type_limit_usage(p, "type_name", "p_retailprice", TYPE_LIMITS, red=80.0)
    return out.select("p_partkey", "type_name", "type_prefix", F.col("type_max").cast(BIG).alias("type_max"),
                      "pct_of_max", "is_abnormal")


def q_object_matrix(spark, d):
    t = Tables(spark, d)
    cust = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    supp = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"))
    return shapes.object_matrix(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], {
        "n_customers": (cust, None),
        "n_suppliers": (supp, None),
        "n_neg_customers": (cust, F.col("c_acctbal") < 0),
    })


# ----------------------------------------------------------- capacity & time
def q_daily_volume(spark, d):
    ev = _ev(Tables(spark, d))
    a = as_of_lit(EV_AS_OF)
    out = time.daily_volume(ev, "ts", "value", ["instance_id"], since=a - F.expr("INTERVAL 10 DAYS"), until=a)
    return out.withColumn("volume", F.col("volume").cast(DBL))


def q_daily_growth(spark, d):
    ev = _ev(Tables(spark, d))
    out = time.daily_growth(ev, ["user_id"], "ts", "value", ["instance_id"], tie="event_id")
    return out.select("instance_id", "day", F.col("total").cast(DBL).alias("total"),
                      F.col("growth").cast(DBL).alias("growth"))


# ------------------------------------------------------- performance history
def _pair(spark, d):
    return perf.snapshot_pair(counters(spark, d), ["instance_id"], "snap_id", "startup")


def q_snapshot_pair(spark, d):
    return _pair(spark, d)


def q_snapshot_delta(spark, d):
    c = counters(spark, d)
    return perf.snapshot_delta(c, _pair(spark, d), ["instance_id"], "snap_id", ["stat"], "value") \
        .select("instance_id", "stat", "begin_snap", "end_snap", "begin_value", "end_value", "delta")


def q_rate_per_second(spark, d):
    c = counters(spark, d)
    delta = perf.snapshot_delta(c, _pair(spark, d), ["instance_id"], "snap_id", ["stat"], "value")
    return perf.rate_per_second(delta, "delta", DAY_S, 6).select("instance_id", "stat", "delta", "per_sec")


def q_ratio_kpi(spark, d):
    ev = _ev(Tables(spark, d))
    t = F.col("event_type")
    w = ev.groupBy("instance_id").agg(F.count_if(t == "error").alias("n_error"), F.count_if(t == "click").alias("n_click"),
                                      F.count_if(t == "view").alias("n_view"), F.count("*").alias("n_all"))  # one scan
    return perf.ratio_kpi(w, {"success_pct": perf.hit_ratio("n_error", "n_all", 4),
                              "ctr_pct": perf.share_ratio("n_click", "n_view", 4)}, red_below=80.0)


def q_time_share(spark, d):
    ev = _ev(Tables(spark, d))
    g = ev.groupBy("instance_id", "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value"))
    out = perf.time_share(g, ["instance_id"], "event_type", "total_value", exclude=["view"], digits=2)
    return out.withColumn("total_value", F.col("total_value").cast(DBL))


# Nations excluded from the Pareto fixture (like idle waits).
PARETO_EXCLUDE = ["NATION_3", "NATION_7"]


def q_pareto(spark, d):
    t = Tables(spark, d)
    per_cust = t.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rev"))
    j = (per_cust.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
                 .join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
                 .filter(~F.col("n_name").isin(PARETO_EXCLUDE))
                 .groupBy("n_name").agg(F.sum("rev").alias("revenue")))
    out = ranking.pareto(j, "revenue", "n_name", n=20, digits=4)
    return out.select("n_name", F.col("revenue").cast(DBL).alias("revenue"), "pct", "running_pct",
                      F.col("rn").cast(BIG).alias("rn"))


SQLWIN_BEGIN, SQLWIN_END = "1996-01-01 00:00:00", "1997-12-31 00:00:00"


def q_sql_window_stats(spark, d):
    t = Tables(spark, d)
    li = t.lineitem.select("l_returnflag", "l_partkey", "l_shipdate",
                           F.col("l_quantity").cast("decimal(18,2)").alias("q"),
                           F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    g = perf.sql_window_stats(li, ["l_returnflag"], ["l_partkey"], "l_shipdate", as_of_lit(SQLWIN_BEGIN),
                              as_of_lit(SQLWIN_END), {"qty": "q", "elapsed": "p"}, share_of="elapsed")
    g = perf.with_texts(g.withColumn("per_exec", fround(safe_div("elapsed", "execs"), 2)),
                        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), ["l_partkey"], "p_name", ["%bolt%"])
    out = ranking.topn(g, [F.col("elapsed").desc(), F.col("l_partkey").asc()], 10, ["l_returnflag"])
    return out.select("l_returnflag", "l_partkey", "p_name", "execs", F.col("qty").cast(DBL).alias("qty"),
                      F.col("elapsed").cast(DBL).alias("elapsed"), "per_exec", "pct_total",
                      F.col("rn").cast(BIG).alias("rn"))


def q_metric_trend(spark, d):
    ev = _ev(Tables(spark, d)).withColumn("day", day_str("ts"))
    return shapes.conditional_pivot(ev, ["instance_id", "day"], "event_type",
                                    {"n_error": "error", "n_click": "click", "n_signup": "signup"}, "count")


def q_counter_trend(spark, d):
    c = counters(spark, d)
    out = perf.counter_trend(c, ["instance_id"], ["stat"], "snap_id", "value", DAY_S, 6)
    return out.select("instance_id", "stat", day_str("d").alias("day"), "value", "rate")


def q_sequence_gap(spark, d):
    c = Tables(spark, d).conversations
    out = perf.sequence_gap(c, ["conv_id"], "turn", F.col("role") == "assistant", 0)
    return out.withColumn("applied", F.col("applied").cast(DBL)).withColumn("gap", F.col("gap").cast(DBL))


# -------------------------------------------------------- aggregation shapes
def q_group_total_sets(spark, d):
    o = Tables(spark, d).orders
    return shapes.group_total_sets(o, ["o_orderstatus", "o_orderpriority"],
                                   [F.count("*").alias("n_orders"),
                                    F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast(DBL).alias("total_price")],
                                   labels={"o_orderstatus": "total", "o_orderpriority": "all"})


def q_rollup_total(spark, d):
    c = Tables(spark, d).customer
    return shapes.rollup_total(c, ["c_nationkey"], "c_mktsegment",
                               [F.count("*").alias("n_customers"),
                                F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast(DBL).alias("total_bal")])


def q_ordered_concat(spark, d):
    t = Tables(spark, d)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return shapes.ordered_concat(n, ["r_name"], "n_name", out="nations")


def q_ordered_concat_distinct(spark, d):
    c = Tables(spark, d).customer
    return shapes.ordered_concat(c, ["c_nationkey"], "c_mktsegment", distinct=True, out="segments")


def q_tagged_union(spark, d):
    t = Tables(spark, d)
    u = relations.tagged_union({
        "customer": t.customer.select(F.col("c_custkey").alias("obj_key"), F.col("c_name").alias("obj_name"),
                                      F.col("c_acctbal").alias("balance")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("obj_key"), F.col("s_name").alias("obj_name"),
                                      F.col("s_acctbal").alias("balance")),
    })
    return u.filter(F.col("balance") < 0).select("tag", "obj_key", "obj_name", "balance")


def q_large_segments(spark, d):
    t = Tables(spark, d)
    li = t.lineitem.select("l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("sz"))
    top = cap.large_segments(li, ["l_partkey"], "sz", 2_000_000, 10, 2_700_000)
    return (top.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
               .select("l_partkey", "p_name", F.col("total_size").cast(DBL).alias("total_size"),
                       F.col("rn").cast(BIG).alias("rn"), "is_abnormal"))


def q_bloat_estimate(spark, d):
    docs = Tables(spark, d).documents
    tables = docs.groupBy("source", "lang").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(F.floor(F.col("doc_id") / 20)).alias("actual_pages"),
        (F.sum("n_chars").cast(DBL) / F.count("*")).alias("avg_width"))
    out = cap.bloat_estimate(tables, ["source", "lang"], "n_rows", "actual_pages", "avg_width")
    return out.select("source", "lang", "n_rows", "actual_pages", "expected_pages", "bloat_pct", "is_abnormal")


def q_fragmentation_class(spark, d):
    li = Tables(spark, d).lineitem
    g = li.groupBy("l_partkey").agg(
        F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("_d"), F.count("*").alias("_n"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast(BIG).alias("pages"))
    g = g.withColumn("frag_pct", fround(F.lit(1000.0) * (F.col("_d").cast(DBL) / F.col("_n")), 2))
    out = verdict.fragmentation_class(g, "frag_pct", "pages", rebuild=55, reorganize=45, min_pages=600)
    return out.select("l_partkey", "frag_pct", "pages", "action", "is_abnormal")


def q_capacity_autoextend(spark, d):
    t = Tables(spark, d)
    files = t.customer.select(
        F.col("c_nationkey").alias("nationkey"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)").alias("bytes"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)") * 2)
         .otherwise(F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)")).alias("maxbytes"))
    free = t.supplier.select(F.col("s_nationkey").alias("nationkey"),
                             F.greatest(F.col("s_acctbal"), F.lit(0.0)).cast("decimal(18,2)").alias("free"))
    out = cap.capacity_autoextend(files, free, ["nationkey"], "bytes", "maxbytes", "free", red=90.0)
    return out.select("nationkey", "n_files", *[F.col(c).cast(DBL).alias(c) for c in
                      ("total_bytes", "max_bytes", "free_bytes", "used_bytes")],
                      "used_pct", "used_of_max_pct", "is_abnormal")


def q_latency_per_op(spark, d):
    ev = Tables(spark, d).events
    err = F.col("event_type") == "error"
    g = ev.groupBy("user_id").agg(F.count_if(err).alias("n_ops"),
                                  F.sum(F.when(err, F.col("value").cast("decimal(18,2)"))).alias("stall"))
    out = verdict.latency_per_op(g, "stall", "n_ops", red=50)
    return out.withColumn("stall", F.col("stall").cast(DBL))


def q_impact_score(spark, d):
    t = Tables(spark, d)
    g = t.lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("n_lines"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast(DBL) / F.count("*")).alias("avg_price"),
        (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast(DBL) / F.count("*")).alias("avg_disc"))
    s = verdict.impact_score(g, ["avg_price", "avg_disc", "n_lines"], "impact")
    top = ranking.topn(s, [F.col("impact").desc(), F.col("l_partkey").asc()], 20)
    return (top.withColumn("is_abnormal", F.col("impact") > 60000)
               .select("l_partkey", "n_lines", "impact", F.col("rn").cast(BIG).alias("rn"), "is_abnormal"))


# ------------------------------------------------------------------- text
# Line classes of the fixture documents (first match wins).
DOC_PATTERNS = [
    ("license", r"(?i)licen[cs]e", "licen"),
    ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", "+1 ("),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "@"),
    ("ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "."),
    ("secret", r"(?i)(password|passwd|secret|api[_-]?key|token)", ("passw", "secret", "api", "token")),
]


def _doc_lines(spark, d):
    return text.split_lines(Tables(spark, d).documents, "text", ["doc_id", "lang"])


def q_log_severity(spark, d):
    return text.log_severity(_doc_lines(spark, d), "line", DOC_PATTERNS, ["lang"])


def q_log_fingerprint(spark, d):
    out = text.log_fingerprint(_doc_lines(spark, d), "line", 10)
    return out.select("message", "n_lines", F.col("rn").cast(BIG).alias("rn"))


def q_log_totals(spark, d):
    return text.log_totals(_doc_lines(spark, d), "line", DOC_PATTERNS, ["lang"])


# Order status codes and labels.
ORDER_STATUS = [("O", "OPEN"), ("F", "FINISHED"), ("P", "PARTIAL")]


def q_status_decode(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus")
    return verdict.status_decode(o, "o_orderstatus", ORDER_STATUS, bad=["P"])


def q_partition_headroom(spark, d):
    o = Tables(spark, d).orders
    parts = (o.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("partition_name"))
              .agg(F.count("*").alias("n_rows"), F.min("o_orderdate").alias("_d")))
    parts = (parts.withColumn("position", (F.year("_d") * 100 + F.month("_d")).cast(BIG))
                  .withColumn("high_value", F.date_format(F.add_months(F.trunc("_d", "month"), 1), "yyyy-MM-dd")))
    return cap.partition_headroom(parts, ["o_orderpriority"], "position", ["partition_name", "high_value", "n_rows"])


# The fixture's suspicious-name patterns (label, LIKE pattern).
IOC_PATTERNS = [("hot", "%hot%"), ("red_bolt", "red bolt%"), ("gizmo", "%gizmo")]


def q_name_ioc(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name")
    return relations.name_ioc(p, "p_name", IOC_PATTERNS)


def q_file_summary(spark, d):
    return cap.file_summary(Tables(spark, d).documents, ["source"], "doc_id", "n_chars")


def q_role_matrix(spark, d):
    lab = Tables(spark, d).labels
    out = verdict.role_matrix(lab, {"quality": "is_quality", "toxic": "is_toxic"},
                              unexpected=(F.col("toxic") == 1) & (F.col("quality") == 1))
    return out.select("doc_id", "is_quality", "is_toxic", "is_abnormal")


def q_host_port_split(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    p = p.withColumn("authority", F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    out = verdict.host_port_split(p, "authority")
    return out.select("page_id", "host", F.col("port").cast(DBL).alias("port"),
                      F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
                      F.col("url").contains("?").alias("has_query"))


def q_os_section_parse(spark, d):
    """Each turn framed as a dump whose first line is a section header with the role."""
    c = Tables(spark, d).conversations
    dump = c.select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("dump"))
    return text.os_section_parse(dump, "dump", ["conv_id", "turn"]).select(
        "conv_id", "turn", "section", F.col("line_no").cast(BIG).alias("line_no"), "line")


def q_split_lines(spark, d):
    c = Tables(spark, d).conversations
    out = text.split_lines(c, "text", ["conv_id", "turn", "role"])
    return out.select("conv_id", "turn", F.col("role").alias("section"), F.col("line_no").cast(BIG).alias("line_no"),
                      "line")


def q_os_usage(spark, d):
    c = Tables(spark, d).customer
    g = c.groupBy("c_nationkey").agg(
        F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)")).alias("pos_bal"),
        F.sum(F.abs(F.col("c_acctbal")).cast("decimal(18,2)")).alias("abs_bal"))
    out = cap.os_usage(g, F.col("pos_bal"), F.col("abs_bal"), "used_pct")
    return out.select("c_nationkey", F.col("pos_bal").cast(DBL).alias("pos_bal"),
                      F.col("abs_bal").cast(DBL).alias("abs_bal"), "used_pct")


def q_html_table_extract(spark, d):
    """Each supplier framed as a report table, negative balances in red."""
    money = F.col("s_acctbal").cast("decimal(18,2)").cast("string")
    balance = F.when(F.col("s_acctbal") < 0, F.concat(F.lit('<font color="red">'), money, F.lit("</font>"))).otherwise(money)
    html = F.concat(F.lit('<table id="supplier" border="1"><tr><th>name</th><th>balance</th></tr><tr><td><b>'), "s_name",
                    F.lit('</b></td><td align="right">'), balance, F.lit("</td></tr><tr><td>nation</td><td>"),
                    F.col("s_nationkey").cast("string"), F.lit("</td></tr></table>"))
    out = text.html_table_extract(Tables(spark, d).supplier.select("s_suppkey", html.alias("html")), "html", ["s_suppkey"])
    return out.withColumn("row_no", F.col("row_no").cast(BIG)).withColumn("col_no", F.col("col_no").cast(BIG))


def q_html_list_extract(spark, d):
    out = text.html_list_extract(Tables(spark, d).pages, "html", ["page_id"])
    return out.withColumn("item_no", F.col("item_no").cast(BIG))


# Fixture priority map (check id, priority, advice).
FIXTURE_PRIORITIES = [
    ("supplier_balance", "high", "investigate negative supplier balances"),
    ("part_size_pct", "low", "review part sizes near the limit"),
    ("event_hour_matrix", "medium", "spread the busiest hours"),
]


def fixture_findings(spark, d) -> DataFrame:
    s = q_threshold_flag(spark, d)
    u = q_utilization_pct(spark, d)
    h = q_hour_matrix(spark, d)
    g = q_sequence_gap(spark, d)
    return fnd.union_findings([
        fnd.to_findings(s, "supplier_balance", F.col("s_suppkey"), F.col("metric"), 0.0),
        fnd.to_findings(u, "part_size_pct", F.col("p_partkey"), F.col("pct"), 90.0),
        fnd.to_findings(h, "event_hour_matrix", F.concat_ws("/", F.col("instance_id").cast("string"), F.col("day")),
                        F.col("total"), 120.0, instance_id=F.col("instance_id").cast("string")),
        fnd.to_findings(g, "conversation_gap", F.col("conv_id"), F.col("gap"), 0.0),
    ])


def q_health_summary(spark, d):
    pr = spark.createDataFrame(FIXTURE_PRIORITIES, "check_id string, priority string, advice string")
    return fnd.health_summary(fixture_findings(spark, d), pr)


# -------------------------------------------------------- store, APPLY, sections
def q_newest_collection(spark, d):
    """Events of each type and day written as collections of a snapshot store, the first half of them twice; then what is newest."""
    root = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    ev = Tables(spark, d).events.select(F.col("event_type").alias("instance_id"), F.lit("events").alias("engine"), day.alias("snapshot_ts"),
                                        "event_id", F.col("value").cast("decimal(18,2)").alias("value"))
    # views stopped being collected in the middle of the period
    ev = ev.filter((F.col("instance_id") != "view") | (F.dayofmonth("snapshot_ts") <= 15))
    write_snapshots(ev, root, "events")
    write_snapshots(ev.filter(F.dayofmonth("snapshot_ts") <= 15), root, "events")
    newest = newest_collections(collections(spark, root), F.lit(EV_AS_OF).cast("timestamp")).checkpoint(eager=True)
    cur = Views({"events": read_snapshots(spark, root, "events")}, newest).current("events")
    out = cur.groupBy("instance_id", F.date_format("snapshot_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n_events"), F.sum("value").cast(DBL).alias("total"), F.min("event_id").alias("first_event"))
    held = read_snapshots(spark, root, "events").groupBy("instance_id").agg(F.count("*").alias("n_held"))
    return out.join(held, "instance_id")


def q_apply_top(spark, d):
    """Each customer with its two largest orders (OUTER APPLY)."""
    t = Tables(spark, d)
    out = relations.apply_rows(t.customer.select("c_custkey", "c_name"), t.orders, [("c_custkey", "o_custkey")],
                               {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice", "o_orderstatus": "o_orderstatus"},
                               order=[F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()], n=2, outer=True)
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast(DBL))


def q_apply_rows(spark, d):
    """Each urgent order with its part lines (CROSS APPLY)."""
    t = Tables(spark, d)
    o = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderstatus")
    return relations.apply_rows(o, t.lineitem, [("o_orderkey", "l_orderkey")],
                                {"l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_quantity": "l_quantity"}) \
        .withColumn("l_linenumber", F.col("l_linenumber").cast(BIG))


def supplier_dumps(spark, d) -> DataFrame:
    """Each supplier framed as an OS dump: a df section, aligned under its header for even keys and squeezed for odd ones,
    a listing of free, and meminfo lines."""
    s = Tables(spark, d).supplier
    size, pct_ = F.floor(F.abs("s_acctbal")).cast("int"), (F.col("s_suppkey") % 101).cast("int")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("/dev/vg "), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name"))
    used = F.when(F.col("s_acctbal") < 0, F.lit("-")).otherwise(F.concat(F.col("s_nationkey").cast("string"), F.lit(".5K")))
    cells = [name, F.lit("xfs"), F.concat(size.cast("string"), F.lit("M")), used, F.lit("0"), F.concat(pct_.cast("string"), F.lit("%")),
             F.concat(F.lit("/data "), F.col("s_suppkey").cast("string"))]
    wide = F.format_string("%-20s %-5s %8s %6s %5s %5s %s", *cells)
    head = F.format_string("%-20s %-5s %8s %6s %5s %5s %s", *[F.lit(x) for x in ("Filesystem", "Type", "Size", "Used", "Avail", "Use%", "Mounted on")])
    odd = F.col("s_suppkey") % 2 == 1
    squeezed = F.concat_ws(" ", *cells)
    free_head = F.lit("              total        used        free      shared  buff/cache   available")
    free = F.format_string("Mem:    %11d %11d %11d", size, F.col("s_nationkey"), pct_)
    lines = [F.lit("diskusage"), F.concat(F.lit("** n"), F.col("s_nationkey").cast("string"), F.lit(":")),
             F.when(odd, F.lit("Filesystem Type Size Used Avail Use% Mounted on")).otherwise(head), F.when(odd, squeezed).otherwise(wide), F.lit(""),
             F.lit("freemem"), free_head, free, F.lit(""), F.lit("meminfo"),
             F.format_string("MemTotal:  %8d kB", size), F.format_string("HugePages_Total:   %d", F.col("s_nationkey")), F.lit("Cached: none")]
    return s.select("s_suppkey", F.concat_ws("\n", *lines).alias("dump"))


def _supplier_sections(spark, d):
    return text.os_sections(supplier_dumps(spark, d), "dump", ["s_suppkey"], sections=["diskusage", "freemem", "meminfo"])


def q_section_table(spark, d):
    out = sections.section_table(_supplier_sections(spark, d), ["s_suppkey"], "diskusage")
    return out.withColumn("line_no", F.col("line_no").cast(BIG)).withColumns({c: F.col(c).cast(DBL) for c in ("size_bytes", "used_bytes", "avail_bytes")})


def q_section_pairs(spark, d):
    """Names and values of meminfo, beside the first columns of free."""
    s = _supplier_sections(spark, d)
    pairs = sections.section_pairs(s, ["s_suppkey"], "meminfo").select("s_suppkey", "line_no", "name", "value", "unit")
    free = sections.section_table(s, ["s_suppkey"], "freemem")
    named = F.inline(F.array(*[F.struct(F.concat("kind", F.lit(n)).alias("name"), F.col(c).alias("value"), F.lit("kB").alias("unit"))
                               for n, c in (("total", "total_kb"), ("used", "used_kb"), ("free", "free_kb"), ("shared", "shared_kb"))]))
    out = pairs.unionByName(free.select("s_suppkey", "line_no", named))
    return out.select("s_suppkey", F.col("line_no").cast(BIG).alias("line_no"), "name", F.col("value").cast(DBL).alias("value"), "unit")


def q_layout_bloat(spark, d):
    """Documents of a source and language as a table, pages of 20 ids; its columns' statistics from the documents."""
    docs, key = Tables(spark, d).documents, ["source", "lang"]
    tables = docs.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(F.floor(F.col("doc_id") / 20)).alias("actual_pages"))
    short = F.when(F.col("n_chars") > 400, F.col("text"))  # a column that is null now and then
    stats = docs.groupBy(*key).agg(
        (F.count_if(short.isNull()).cast(DBL) / F.count("*")).alias("text_nulls"), F.floor(F.avg("n_chars") / 40).cast("int").alias("text_wide"))
    stats = stats.select(*key, F.inline(F.array(
        F.struct(F.lit("doc_id").alias("attname"), F.lit(0.0).alias("null_frac"), F.lit(8).alias("avg_width")),
        F.struct(F.lit("text").alias("attname"), F.when(F.col("lang") == "en", F.col("text_nulls")).otherwise(0.0).alias("null_frac"),
                 F.col("text_wide").alias("avg_width")))))
    out = cap.layout_bloat(tables, stats, key, "n_rows", "actual_pages", page_size=128, min_pages=3)
    return out.select(*key, "n_rows", "actual_pages", "expected_pages", "bloat_bytes", "bloat_pct", "is_abnormal")


def q_type_limit_join(spark, d):
    """``type_limit_usage`` with its limits in a table."""
    p = Tables(spark, d).part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("type_name"), "p_retailprice")
    limits = spark.createDataFrame([(a, b, c) for a, b, c in TYPE_LIMITS], "prefix string, signed_max bigint, unsigned_max bigint")
    out = relations.type_limit_usage(p, "type_name", "p_retailprice", limits, red=80.0)
    return out.select("p_partkey", "type_name", "type_prefix", F.col("type_max").cast(BIG).alias("type_max"), "pct_of_max", "is_abnormal")


# --------------------------------------------- guaranteed rows, records, lists
def q_guaranteed_rows(spark, d):
    """Each nation with its overdrawn machinery customers, or a line of defaults."""
    t = Tables(spark, d)
    c = t.customer.filter((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < -900)).select(
        F.col("c_nationkey").alias("n_nationkey"), "c_name", F.col("c_acctbal").alias("balance"))
    return relations.guaranteed_rows(t.nation, c, ["n_nationkey"], {"c_name": "N/A", "balance": 0}, present="found")


def _doc_pieces(spark, d):
    """Lines of the documents, in pieces of three as a split file has them."""
    return text.split_lines(Tables(spark, d).documents, "text", ["doc_id"]).withColumn("piece", F.floor((F.col("line_no") - 1) / 3))


def q_log_records(spark, d):
    """Lines of a document that begin with a capital begin a record; its timestamp is their number."""
    out = text.log_records(_doc_pieces(spark, d), ["doc_id"], "piece", "line_no", "line", F.col("line").rlike("^[A-Z]"),
                           F.col("line_no"), max_lines=100_000)
    return out.select("doc_id", "record_no", F.col("record_ts").cast(DBL).alias("record_ts"), "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_log_recent(spark, d):
    """Events as log lines: errors and large purchases of the seven days before an instant, the most recent first."""
    ev = Tables(spark, d).events.select("event_id", "user_id", "ts", F.concat_ws(" ", "event_type", F.col("value").cast("decimal(18,2)").cast("string")).alias("line"))
    out = text.log_severity(ev, "line", [("error", "^error [1-9][0-9]"), ("large", r"^purchase [0-9]{2,}\.")], ["user_id", "ts"],
                            ts="ts", as_of=as_of_lit("2024-01-20 00:00:00"), days=7)
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def q_abnormal_list(spark, d):
    """The health summary with the three worst objects of each check; two checks that were due have no findings."""
    pr = spark.createDataFrame(FIXTURE_PRIORITIES, "check_id string, priority string, advice string")
    f = fixture_findings(spark, d)
    due = Tables(spark, d).region.select(F.concat(F.lit("region_"), F.lower("r_name")).alias("check_id"),
                                         F.when(F.col("r_regionkey") == 0, "not readable").alias("error")).filter(F.col("error").isNotNull() | (F.length("check_id") > 10))
    ran = due.unionByName(f.select("check_id").distinct().withColumn("error", F.lit(None).cast("string")))
    out = fnd.health_summary(f, pr, ran=ran, worst=3)
    items = F.array_join(F.transform("abnormal_items", lambda x: x["object_key"]), ", ")
    return out.select("check_id", "n_normal", "n_abnormal", "priority", "advice", "status", "error", items.alias("worst"),
                      F.size("abnormal_items").cast(BIG).alias("n_worst"))


# ------------------------------------------------------- reports without a group
def q_statement_report(spark, d):
    """Parts as statements between two instants: the five heaviest of each return flag whose names are no excluded ones."""
    t = Tables(spark, d)
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    li = t.lineitem.select("l_returnflag", "l_partkey", "l_shipdate", price.alias("p"),
                           (price * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)").alias("c"),
                           F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    out = perf.statement_report(li, ["l_returnflag"], "l_partkey", "l_shipdate", as_of_lit(SQLWIN_BEGIN), as_of_lit(SQLWIN_END),
                                {"elapsed": "p", "cpu": "c", "qty": "q"}, "elapsed", 5, shares={"pct_cpu": ("cpu", "elapsed"), "pct_qty": ("qty", "elapsed")},
                                texts=t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), text="p_name", not_like=["%bolt%", "small%"])
    return out.select("l_returnflag", "l_partkey", "p_name", "execs", F.col("elapsed").cast(DBL).alias("elapsed"), "per_exec", "pct_total",
                      "pct_cpu", "pct_qty", F.col("rn").cast(BIG).alias("rn"))


def q_partition_bound(spark, d):
    """Months of an order priority as partitions whose upper bounds are seven bytes of a date."""
    o = Tables(spark, d).orders
    parts = o.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("_m")).agg(F.count("*").alias("n_rows"))
    end = F.add_months("_m", 1)
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    raw = F.unhex(F.concat(byte(F.floor(F.year(end) / 100) + 100), byte(F.year(end) % 100 + 100), byte(F.month(end)), byte(F.dayofmonth(end)),
                           F.lit("010101")))
    parts = parts.select("o_orderpriority", "n_rows", F.date_format("_m", "yyyy-MM").alias("partition_name"), raw.alias("high_value_raw"),
                         (F.year("_m") * 100 + F.month("_m")).cast(BIG).alias("position"))
    out = cap.partition_headroom(parts, ["o_orderpriority"], "position", ["partition_name", "n_rows"], bound_raw="high_value_raw",
                                 as_of=as_of_lit("2001-07-20 00:00:00"), days=14)
    return out.select("o_orderpriority", "position", "partition_name", "n_rows", F.date_format("upper_bound", "yyyy-MM-dd HH:mm:ss").alias("upper_bound"),
                      F.col("days_left").cast(BIG).alias("days_left"), "is_abnormal")


def q_pareto_all(spark, d):
    """Every customer's revenue with its running share of all revenue: one order over all rows, no group."""
    o = Tables(spark, d).orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    out = ranking.pareto(o, "revenue", "o_custkey", digits=4)
    return out.select("o_custkey", F.col("revenue").cast(DBL).alias("revenue"), "pct", "running_pct", F.col("rn").cast(BIG).alias("rn"))


def q_time_share_all(spark, d):
    """Each event type's share of all values but those of views."""
    g = Tables(spark, d).events.groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value"))
    return perf.time_share(g, [], "event_type", "total_value", exclude=["view"], digits=3).withColumn("total_value", F.col("total_value").cast(DBL))


def q_nested_rollup(spark, d):
    """Customers by nation, segment and sign of their balance: a line for each nation, segment of a nation, and sign in it."""
    c = Tables(spark, d).customer.select("c_nationkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("overdrawn"),
                                         F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), "c_custkey")
    out = shapes.nested_rollup(c, ["c_nationkey", "c_mktsegment", "overdrawn"],
                               {"n_customers": F.count("*"), "balance": F.sum("balance"), "first_key": F.min("c_custkey")}, merge={"first_key": "min"})
    return out.select("c_nationkey", "c_mktsegment", F.col("overdrawn").cast("string").alias("overdrawn"), F.col("level").cast(BIG).alias("level"),
                      "n_customers", F.col("balance").cast(DBL).alias("balance"), "first_key")


def q_log_fingerprint_recent(spark, d):
    """Events as lines of a log with timestamps: the messages of seven days; those of users in ten have no time of their own."""
    ev = Tables(spark, d).events
    body = F.concat(F.lit("[ERROR] "), "event_type", F.lit(" by user "), (F.col("user_id") % 7).cast("string"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("  "), body)).otherwise(F.concat(stamp, F.lit("+00:00 "), body))
    lines = ev.select("event_type", line.alias("line"))
    out = text.log_fingerprint(lines, "line", 4, ["event_type"], strip=text.LEADING_TIMESTAMP, as_of=as_of_lit("2024-01-20 00:00:00").cast("timestamp"), days=7)
    return out.withColumn("rn", F.col("rn").cast(BIG))


def q_sequence_gap_current(spark, d):
    """Turns that an assistant has answered against the last turn of each conversation, from two frames."""
    c = Tables(spark, d).conversations
    return perf.sequence_gap(c, ["conv_id"], "turn", F.col("role") == "assistant", 1, current=c.filter(F.col("role") != "system"))


def q_position_lag(spark, d):
    """Orders and lines of a customer as positions of a log, both as hex halves; what is sent and not replayed."""
    t = Tables(spark, d)
    o = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("sent"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("done"))
    lsn = lambda x: F.concat(F.hex(F.floor(x / 64)), F.lit("/"), F.hex((x % 64) * 67108864))
    out = perf.position_lag(o.select("o_custkey", lsn(F.col("sent")).alias("sent_lsn"), lsn(F.col("done")).alias("replay_lsn")), "sent_lsn", "replay_lsn", 10 ** 10)
    return out.withColumn("lag_bytes", F.col("lag_bytes").cast(DBL))


def q_html_span_extract(spark, d):
    """Each supplier framed as the scalar facts of a report."""
    s = Tables(spark, d).supplier
    html = F.concat(F.lit('<h1>r</h1><span id="name">'), "s_name", F.lit('</span><span id="nation" class="x">'), F.col("s_nationkey").cast("string"),
                    F.lit('</span> <span>none</span><span id="empty"></span>'))
    return text.html_span_extract(s.select("s_suppkey", html.alias("html")), "html", ["s_suppkey"])


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
