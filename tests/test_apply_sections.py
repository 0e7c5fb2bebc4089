"""APPLY, section columns, tuple layout and longest-prefix joins on literal rows, and the checks that use them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_checks_literal import by, ctx, run, view

from fleetcheck.operators import capacity as cap
from fleetcheck.operators import relations, sections, text
from fleetcheck.plans import fixtures


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- APPLY ----------------------------------------------------------------------------------------------------

def test_apply_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (1, "a")], "id int, k string")
    right = spark.createDataFrame([("a", 5, "p"), ("a", 7, "q"), ("a", 7, "p"), ("b", None, "r"), (None, 3, "s")], "k string, v int, t string")
    cross = relations.apply_rows(left, right, [("k", "k")], {"value": "v", "tag": "t"})
    assert rows(cross, "id", "k", "value", "tag") == sorted(
        [(1, "a", 5, "p"), (1, "a", 7, "q"), (1, "a", 7, "p")] * 2 + [(2, "b", None, "r")], key=repr)
    top = relations.apply_rows(left, right, [("k", "k")], {"value": "v", "tag": "t"}, [F.col("v").desc_nulls_last(), F.col("t")], 1, outer=True)
    assert rows(top, "id", "value", "tag") == sorted([(1, 7, "p"), (1, 7, "p"), (2, None, "r"), (3, None, None), (4, None, None)], key=repr)
    none = relations.apply_rows(left, right.limit(0), [("k", "k")], {"value": "v"}, [F.col("v")], 2, outer=True)
    assert len(none.collect()) == 5 and relations.apply_rows(left.limit(0), right, [("k", "k")], {"value": "v"}).collect() == []


def test_apply_top_limits_before_its_shuffle(spark, capsys):
    fixtures.QUERIES["apply_top"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan.split("Exchange")[-1] and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- section columns ------------------------------------------------------------------------------------------

DUMP = """diskusage
** h1:
Filesystem                Type      Size  Used Avail Use% Mounted on
devtmpfs                  devtmpfs  3.8G     0  3.8G   0% /dev
/dev/mapper/vg long name  xfs        17G   16G  1.0G  95% /data one
//nas/share               cifs         -     -     -    - /nas

** h2:
some warning of the command
Filesystem Type Size Used Avail Use% Mounted on
/dev/a xfs 1G 1G 0G 95% /
too short

inode
Filesystem     Type     Inodes IUsed IFree IUse% Mounted on
/dev/sda1      ext4       128K   12K  116K   10% /

freemem
              total        used        free      shared  buff/cache   available
Mem:        8009188     1508312     4386772       17116     2114104     6219564
Swap:       2097148           0     2097148
Huge: 123456789012345 123456789012344 1 2 3 4

meminfo
MemTotal:        8009188 kB
HugePages_Total:       0
Odd: x kB
no separator
"""
G = 1 << 30


@pytest.fixture(scope="module")
def dumps(spark):
    d = spark.createDataFrame([(1, DUMP), (2, None), (3, ""), (4, "freemem\n  total used free\nMem: 100 60 40\nSwap: 0 0 0\n"),
                               (5, "diskusage\nno header here\n"), (6, DUMP.replace("\n", "\r\n"))], "id int, t string")
    return text.os_sections(d, "t", ["id"], sections=list(sections.LAYOUTS) + ["meminfo"])


@pytest.mark.parametrize("i", [1, 6])
def test_df_columns(dumps, i):
    got = sections.section_table(dumps, ["id"], "diskusage").filter(F.col("id") == i)
    cells = ("host", "line_no", "filesystem", "fstype", "size_bytes", "used_bytes", "avail_bytes", "used_pct", "mount")
    assert sorted(map(tuple, got.select(*cells).collect()), key=lambda r: r[1])[:4] == [
        ("h1", 4, "devtmpfs", "devtmpfs", round(3.8 * G), 0, round(3.8 * G), 0.0, "/dev"),
        ("h1", 5, "/dev/mapper/vg long name", "xfs", 17 * G, 16 * G, G, 95.0, "/data one"),
        ("h1", 6, "//nas/share", "cifs", None, None, None, None, "/nas"),
        ("h2", 11, "/dev/a", "xfs", G, G, 0, 95.0, "/")]
    inode = sections.section_table(dumps, ["id"], "inode").filter(F.col("id") == i).first()
    assert (inode["inodes"], inode["iused"], inode["ifree"], inode["used_pct"], inode["mount"]) == (128 << 10, 12 << 10, 116 << 10, 10.0, "/")


def test_free_and_meminfo(dumps):
    got = sections.section_table(dumps, ["id"], "freemem").filter(F.col("id") != 6)
    assert rows(got, "id", "kind", "total_kb", "used_kb", "free_kb", "shared_kb", "available_kb") == sorted([
        (1, "Mem:", 8009188, 1508312, 4386772, 17116, 6219564), (1, "Swap:", 2097148, 0, 2097148, None, None),
        (1, "Huge:", 123456789012345, 123456789012344, 1, 2, 4),  # numbers that outgrew their columns
        (4, "Mem:", 100, 60, 40, None, None), (4, "Swap:", 0, 0, 0, None, None)], key=repr)
    pairs = sections.section_pairs(dumps, ["id"], "meminfo").filter(F.col("id") == 1)
    assert rows(pairs, "name", "value", "unit") == sorted([("MemTotal", 8009188, "kB"), ("HugePages_Total", 0, None), ("Odd", None, "kB")], key=repr)


def test_sections_are_read_within_the_row(spark):
    for key in ("section_table", "section_pairs"):
        plan = fixtures.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_filters_on_cells_stay_above_the_steps_that_make_them(spark):
    """A filter pushed below them holds every step once for each of its uses, and is most of the run."""
    for key in ("section_table", "section_pairs"):
        out = fixtures.QUERIES[key](spark, "/root/testdata/sf0.001")
        for d in (out, out.filter(F.col(out.columns[-1]).isNotNull())):
            plan = d._jdf.queryExecution().optimizedPlan().toString()
            assert not [x for x in plan.split("\n") if "Filter (" in x and "regexp_extract(substring(" in x]


def test_random_tables_read_back(spark):
    g = random.Random(4)
    data, want = [], []
    for i in range(200):
        r = [(g.choice(["/dev/sda1", "tmp fs", "x" * g.randint(1, 30)]), "ext4", str(g.randint(0, 9)) + "G", g.choice(["-", "7K", "0"]), "1.5M",
              f"{g.randint(0, 100)}%", "/" + g.choice(["", "a", "b c/d", "e" * 20])) for _ in range(g.randint(1, 4))]
        head = ("Filesystem", "Type", "Size", "Used", "Avail", "Use%", "Mounted on")
        wide = [max(len(x[k]) for x in [head, *r]) for k in range(7)]
        line = lambda x: " ".join(x[k].ljust(wide[k]) if k in (0, 1, 6) else x[k].rjust(wide[k]) for k in range(7)).rstrip()
        data.append((i, "\n".join(["diskusage", line(head), *map(line, r), ""])))
        want += [(i, x[0], int(x[2][:-1]) * G, {"-": None, "7K": 7168, "0": 0}[x[3]], float(x[5][:-1]), x[6]) for x in r]
    s = text.os_sections(spark.createDataFrame(data, "id int, t string"), "t", ["id"], sections=["diskusage"])
    got = sections.section_table(s, ["id"], "diskusage")
    assert rows(got, "id", "filesystem", "size_bytes", "used_bytes", "used_pct", "mount") == sorted(want, key=repr)


def test_host_checks_read_columns(spark):
    c = ctx(spark, "host", {"os_text": view(spark, "host", "os_text", [{"instance_id": "a", "path": "p", "text": DUMP}])})
    got = by(run(c, "H05").filter(F.col("mount").isNotNull()), "host", "kind", "mount", "is_abnormal")
    assert got[("h1", "space", "/data one")] is True and got[("h1", "space", "/dev")] is False and got[("h2", "space", "/")] is True
    assert got[("h1", "space", "/nas")] is False and got[(None, "inode", "/")] is False
    m = run(c, "H04").first()
    assert (m["mem_total_kb"], m["mem_used_pct"], m["swap_used_pct"]) == (8009188, 18.83, 0.0)
    assert by(run(c, "H06").filter(F.col("mi_name").isNotNull()), "mi_name", "mi_kb") == {("MemTotal",): 8009188, ("HugePages_Total",): 0, ("Odd",): None}


# --- tuple layout ---------------------------------------------------------------------------------------------

def test_layout_bloat_gives_the_pages_of_the_formula(spark):
    tables = spark.createDataFrame([("padded", 100000.0, 1000), ("even", 100000.0, 1000), ("plain", 100000.0, 1000), ("bare", 100000.0, 52),
                                    ("tiny", 100.0, 8), ("empty", 0.0, 1000), ("full", 100000.0, 54)], "t string, n double, pages bigint")
    stats = spark.createDataFrame([("padded", "a", 0.1, 3), ("padded", "b", 0.0, 30), ("even", "a", 0.5, 62), ("plain", "a", 0.0, 500),
                                   ("plain", "b", None, None), ("other", "a", 0.1, 9)], "t string, attname string, null_frac double, avg_width int")
    got = cap.layout_bloat(tables, stats, ["t"], "n", "pages")
    # padded: (2 + 30) / 8 = 4 bytes and 8 - 4 of padding, 12 a tuple; even: 8 and none, 12; without nulls 4 alone
    assert rows(got, "t", "expected_pages", "bloat_pct", "bloat_bytes", "is_abnormal") == [
        ("even", 148, 85.2, 852 * 8192, True), ("padded", 148, 85.2, 852 * 8192, True), ("plain", 50, 95.0, 950 * 8192, True)]
    low = cap.layout_bloat(tables, stats, ["t"], "n", "pages", listed=0.0)
    assert rows(low, "t", "bloat_pct", "is_abnormal")[:1] == [("bare", 3.8, False)]


def test_bloat_check_with_the_layout(spark):
    e = "postgres"
    views = {"tables": view(spark, e, "tables", [{"instance_id": "p", "schemaname": "s", "relname": n, "relkind": "r", "relpages": 40, "reltuples": 660.0}
                                                 for n in ("wide", "none")]),
             "column_stats": view(spark, e, "column_stats", [{"instance_id": "p", "schemaname": "s", "tablename": "wide", "attname": "c", "null_frac": 0.1, "avg_width": 2000}])}
    got = by(run(ctx(spark, e, views, bloat_model="layout"), "P13"), "relname", "expected_pages")
    assert got == {("none",): 2, ("wide",): 23}  # (2 + 2000) / 8 = 250.25, padded to 256: 260 bytes a tuple, 31.4 a page, one page more


# --- longest prefix -------------------------------------------------------------------------------------------

def test_longest_prefix_join_equals_brute_force(spark):
    g = random.Random(2)
    word = lambda n: "".join(g.choice("ab ") for _ in range(n))
    limits = [(word(g.randint(0, 6)), g.randint(1, 99)) for _ in range(60)] + [(None, 5)]
    texts = [(i, g.choice([word(g.randint(0, 9)), "aab", None])) for i in range(300)] + [(1000 + i, "hot text") for i in range(200)]
    best = {}
    for p, v in limits:
        if p is not None:
            best[p] = min(v, best.get(p, v))
    want = []
    for i, t in texts:
        held = [p for p in best if t is not None and t.startswith(p)]
        p = max(held, key=len, default=None)
        want.append((i, t, p, best.get(p)))
    df = spark.createDataFrame(texts, "id int, t string").repartition(4)
    got = relations.longest_prefix_join(df, "t", spark.createDataFrame(limits, "p string, v int"), "p", ["v"])
    assert rows(got, "id", "t", "p", "v") == sorted(want, key=repr)
    none = relations.longest_prefix_join(df, "t", spark.createDataFrame([], "p string, v int"), "p", ["v"])
    assert len(none.collect()) == len(texts) and none.filter(F.col("p").isNotNull()).count() == 0


def test_a_table_of_limits_gives_the_rows_of_the_case_chain(spark):
    from fleetcheck.plans.checks.mysql import INT_LIMITS
    types = ["int", "INT(11)", "int unsigned", "int(10) unsigned zerofill", "tinyint(1)", "bigint unsigned", "varchar(9)", None, "mediumint", "integer"]
    df = spark.createDataFrame([(i, t, 100 + i) for i, t in enumerate(types * 3)], "id int, t string, v bigint")
    table = spark.createDataFrame([(p, str(s), None if u is None else str(u)) for p, s, u in INT_LIMITS], "prefix string, signed_max string, unsigned_max string")
    cols = ("id", "type_prefix", "type_max", "pct_of_max", "is_abnormal")
    chain, joined = relations.type_limit_usage(df, "t", "v", INT_LIMITS), relations.type_limit_usage(df, "t", "v", table)
    assert rows(joined, *cols) == rows(chain, *cols) and len(rows(chain, *cols)) == 30


# --- checks over base views -----------------------------------------------------------------------------------

E = "sqlserver"


def of(spark, name, *data):
    return view(spark, E, name, [{"instance_id": "a", **r} for r in data])


def test_always_on_from_base_views(spark):
    views = {"availability_groups": of(spark, "availability_groups", {"group_id": "g", "ag_name": "AG"}),
             "availability_replicas": of(spark, "availability_replicas", *[{"group_id": "g", "replica_id": f"r{i}", "replica_server": f"s{i}"} for i in range(4)]),
             "replica_states": of(spark, "replica_states", {"replica_id": "r0", "role_desc": "PRIMARY", "synchronization_health": "HEALTHY"},
                                  {"replica_id": "r1", "role_desc": "SECONDARY", "synchronization_health": "HEALTHY"},
                                  {"replica_id": "r2", "synchronization_health": "NOT_HEALTHY"}),
             "database_replica_states": of(spark, "database_replica_states", {"replica_id": "r0", "database_name": "d", "synchronization_state": "SYNCHRONIZED"},
                                           {"replica_id": "r1", "database_name": "d", "synchronization_state": "NOT SYNCHRONIZING"})}
    got = rows(run(ctx(spark, E, views), "S06"), "replica_server", "role_desc", "synchronization_state", "is_abnormal")
    assert got == [("s0", "PRIMARY", "SYNCHRONIZED", False), ("s1", "SECONDARY", "NOT SYNCHRONIZING", True), ("s2", "UNKNOWN", None, True), ("s3", "UNKNOWN", None, True)]


def test_transaction_log_from_base_views(spark):
    views = {"databases": of(spark, "databases", {"database_name": "app", "database_id": 5, "state": "ONLINE", "log_reuse_wait": "LOG_BACKUP"},
                             {"database_name": "other", "database_id": 6, "state": "ONLINE"}, {"database_name": "off", "database_id": 7, "state": "OFFLINE"},
                             {"database_name": "nolog", "database_id": 8, "state": "ONLINE"}),
             "files": of(spark, "files", {"database_name": "app", "type_desc": "LOG", "size_pages": 999}, {"database_name": "other", "type_desc": "LOG", "size_pages": 128},
                         {"database_name": "other", "type_desc": "LOG", "size_pages": 128}, {"database_name": "other", "type_desc": "ROWS", "size_pages": 128}),
             "log_space_usage": of(spark, "log_space_usage", {"database_id": 5, "total_bytes": 10 << 20, "used_bytes": 8 << 20, "used_pct": 80.0})}
    got = rows(run(ctx(spark, E, views), "S07"), "database_name", "log_size_mb", "used_mb", "log_used_pct", "log_reuse_wait", "is_estimate", "is_abnormal")
    assert got == [("app", 10.0, 8.0, 80.0, "LOG_BACKUP", False, True), ("other", 2.0, 0.0, 0.0, "N/A", True, False)]


def test_top_queries_fetch_their_texts(spark):
    stats = [{"query_hash": f"q{i:02d}", "sql_handle": f"h{i}", "execution_count": 1, "total_worker_time": 1000 * (100 - i)} for i in range(40)]
    texts = [{"sql_handle": f"h{i}", "text": "SELECT " + "x" * 400} for i in range(3, 40)] + [{"sql_handle": "h5", "text": None}]
    got = rows(run(ctx(spark, E, {"query_stats": of(spark, "query_stats", *stats), "sql_texts": of(spark, "sql_texts", *texts)}), "S18"), "query_hash", "sql_text")
    assert [q for q, _ in got] == [f"q{i:02d}" for i in range(3, 23)] and {len(t) for _, t in got} == {300}


def test_jobs_have_schedules_and_tables_keys(spark):
    views = {"jobs": of(spark, "jobs", {"job_id": "1", "name": "two", "enabled": 1}, {"job_id": "2", "name": "none", "enabled": 0}),
             "job_history": of(spark, "job_history", {"job_id": "1", "step_id": 0, "run_status": 0, "run_date": 20240130, "run_time": 1}),
             "job_schedules": of(spark, "job_schedules", {"job_id": "1", "schedule_id": 1}, {"job_id": "1", "schedule_id": 2}),
             "schedules": of(spark, "schedules", {"schedule_id": 1, "name": "nightly"}, {"schedule_id": 2, "name": "weekly"})}
    got = rows(run(ctx(spark, E, views), "S05"), "name", "schedule", "last_status", "run_ts", "is_abnormal")
    at = dt.datetime(2024, 1, 30, 0, 0, 1)
    assert got == [("none", "No Schedule", "N/A", None, False), ("two", "nightly", "Failed", at, True), ("two", "weekly", "Failed", at, True)]
    keys = [{"database_name": "d", "schema_name": "s", "table_name": t, "type": k} for t, k in (("keyed", "PK"), ("unique", "UQ"))]
    tables = [{"database_name": "d", "schema_name": "s", "table_name": t, "row_count": 1, "data_kb": 1024, "index_kb": 0} for t in ("keyed", "unique", "heap")]
    got = run(ctx(spark, E, {"tables": of(spark, "tables", *tables), "key_constraints": of(spark, "key_constraints", *keys)}), "S20")
    assert rows(got, "table_name", "size_mb") == [("heap", 1.0), ("unique", 1.0)]
