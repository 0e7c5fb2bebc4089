"""Property tests: delta additivity, percentages that add up to
100 before the top-n cut, running percent non-decreasing, anti + semi
partition the input, health-summary counts equal findings counts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetcheck.operators import findings as fnd
from fleetcheck.operators import perf, ranking, relations

SETTINGS = settings(max_examples=8, deadline=None)


@SETTINGS
@given(st.lists(st.integers(0, 10 ** 6), min_size=3, max_size=3), st.integers(1, 5))
def test_delta_additivity(spark, incs, n_stats):
    # monotone counters at snaps 1 < 2 < 3: delta(1,3) = delta(1,2) + delta(2,3)
    rows = []
    for s in range(n_stats):
        v = 0
        for snap, inc in zip((1, 2, 3), incs):
            v += inc + s
            rows.append(("i", snap, f"s{s}", v))
    stats = spark.createDataFrame(rows, "instance_id string, snap_id int, stat string, value long")

    def d(b, e):
        pair = spark.createDataFrame([("i", b, e)], "instance_id string, begin_snap int, end_snap int")
        out = perf.snapshot_delta(stats, pair, ["instance_id"], "snap_id", ["stat"], "value")
        return {r.stat: r.delta for r in out.collect()}

    d12, d23, d13 = d(1, 2), d(2, 3), d(1, 3)
    assert d13 == {k: d12[k] + d23[k] for k in d13}


@SETTINGS
@given(st.lists(st.integers(1, 10 ** 6), min_size=1, max_size=30))
def test_pareto_percentages(spark, values):
    df = spark.createDataFrame([(f"k{i:02d}", v) for i, v in enumerate(values)], "k string, v long")
    rows = sorted(ranking.pareto(df, "v", "k", digits=4).collect(), key=lambda r: r.rn)
    assert abs(sum(r.pct for r in rows) - 100.0) <= 0.5e-4 * len(rows) + 1e-9
    run = [r.running_pct for r in rows]
    assert all(a <= b for a, b in zip(run, run[1:])) and abs(run[-1] - 100.0) < 1e-9
    assert [r.v for r in rows] == sorted(values, reverse=True)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "idle"]), st.integers(0, 1000)), min_size=1, max_size=20))
def test_time_share_sums_to_100(spark, rows):
    df = spark.createDataFrame([("i", k, v) for k, v in rows], "inst string, k string, v long") \
        .groupBy("inst", "k").agg(F.sum("v").alias("v"))
    out = perf.time_share(df, ["inst"], "k", "v", exclude=["idle"]).collect()
    kept = [r.pct for r in out if r.k != "idle"]
    total = sum(v for k, v in rows if k != "idle")
    if total > 0:
        assert abs(sum(kept) - 100.0) <= 0.005 * len(kept) + 1e-9
    assert all(r.pct is None for r in out if r.k == "idle")


@SETTINGS
@given(st.sets(st.integers(0, 50), max_size=30), st.sets(st.integers(0, 50), max_size=30))
def test_anti_and_semi_partition_input(spark, ents, rel):
    e = spark.createDataFrame([(x,) for x in ents], "k int")
    r = spark.createDataFrame([(x,) for x in rel], "k int")
    a = {x.k for x in relations.missing_related(e, r, "k").collect()}
    s = {x.k for x in relations.member_of(e, r, "k").collect()}
    assert a | s == set(ents) and not (a & s)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["c1", "c2", "c3"]), st.booleans()), min_size=1, max_size=25))
def test_summary_counts_equal_findings(spark, rows):
    f = spark.createDataFrame([(c, str(i), ab) for i, (c, ab) in enumerate(rows)],
                              "check_id string, k string, is_abnormal boolean")
    pr = spark.createDataFrame([], "check_id string, priority string, advice string")
    s = {r.check_id: (r.n_normal, r.n_abnormal) for r in fnd.health_summary(f, pr).collect()}
    for c in {c for c, _ in rows}:
        assert s[c] == (sum(1 for x, ab in rows if x == c and not ab), sum(1 for x, ab in rows if x == c and ab))


# ---- re-aimed operators against brute force --------------------------------
lists_st = st.dictionaries(st.sampled_from(["i1", "i2", "i3", "i4", "i5", "i6"]),
                           st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=4), min_size=1, max_size=6)


@SETTINGS
@given(lists_st, st.sampled_from([None, 2]))
def test_redundant_index_matches_brute_force(spark, idx, block):
    rows = [("t", name, pos * 3 + 1, c) for name, cols in idx.items() for pos, c in enumerate(cols)]
    df = spark.createDataFrame(rows, "tbl string, idx string, pos int, col string")
    got = {(r.idx, r.width, r.n_covering, r.first_covering)
           for r in relations.redundant_index(df, ["tbl"], "idx", "pos", "col", block=block).collect()}
    want = set()
    for a, ca in idx.items():
        cov = sorted(b for b, cb in idx.items() if len(cb) > len(ca) and cb[:len(ca)] == ca)
        if cov:
            want.add((a, len(ca), len(cov), cov[0]))
    assert got == want


@SETTINGS
@given(lists_st)
def test_duplicate_index_matches_brute_force(spark, idx):
    rows = [("t", name, pos + 1, c) for name, cols in idx.items() for pos, c in enumerate(cols)]
    df = spark.createDataFrame(rows, "tbl string, idx string, pos int, col string")
    got = {(r.idx, r.pos, r.col, r.n_sharing, r.first_index, r.last_index)
           for r in relations.duplicate_index(df, ["tbl"], "idx", "pos", "col").collect()}
    want = set()
    slots = {}
    for name, cols in idx.items():
        for pos, c in enumerate(cols):
            slots.setdefault((pos + 1, c), set()).add(name)
    for (pos, c), members in slots.items():
        if len(members) > 1:
            for m in members:
                want.add((m, pos, c, len(members), min(members), max(members)))
    assert got == want


locks_st = st.lists(st.tuples(st.integers(1, 6), st.booleans(), st.sampled_from(["x", "y", None])),
                    min_size=1, max_size=12)


@SETTINGS
@given(locks_st)
def test_blocking_pairs_matches_brute_force(spark, locks):
    df = spark.createDataFrame(locks, "pid int, granted boolean, rel string")
    got = {(r.waiter, r.rel, r.n_holders, r.first_holder)
           for r in relations.blocking_pairs(df, ["rel"], "pid", F.col("granted")).collect()}
    want = set()
    for pid, granted, rel in locks:
        if granted:
            continue
        holders = {p for p, g, r in locks if g and r == rel and p != pid}
        if holders:
            want.add((pid, rel, len(holders), min(holders)))
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 23), st.integers(0, 59)), min_size=1, max_size=40))
def test_hour_matrix_cells_sum_to_total(spark, evs):
    import datetime as dt
    from fleetcheck.operators import time as tops
    df = spark.createDataFrame([(i % 2, dt.datetime(2024, 1, 1 + d, h, m)) for i, (d, h, m) in enumerate(evs)],
                               "inst int, ts timestamp")
    for r in tops.hour_matrix(df, "ts", ["inst"], 10, 100).collect():
        assert sum(r[f"h{h:02d}"] for h in range(24)) == r.total
