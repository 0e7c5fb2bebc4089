"""Log records across file splits, guaranteed rows, abnormal lists, and the checks that use them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_checks_literal import ctx, run, view

from fleetcheck.operators import findings as fnd
from fleetcheck.operators import relations, text
from fleetcheck.sources import parse_log_lines, read_log_lines


def write_log(path, g, n, hot=False):
    """A log whose records have continuation lines, and its records as (timestamp, text)."""
    lines, records = ["preamble", ""], [[None, ["preamble", ""]]]
    for i in range(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
        more = [g.choice(["  at frame", "ORA-00600: x", "", "Caused by 2024-01-01 y"]) for _ in range(4000 if hot and i == 3 else g.choice([0, 0, 1, 5]))]
        head = f"{at:%Y-%m-%d %H:%M:%S} line {i} " + "x" * g.randint(0, 60)
        lines += [head, *more]
        records.append([at, [head, *more]])
    path.write_text("\n".join(lines) + "\n")
    return [(t, "\n".join(x)) for t, x in records]


@pytest.mark.parametrize("split", [700, 10_000_000])
def test_records_are_whole_across_splits(spark, tmp_path, split):
    g = random.Random(6)
    want = {n: write_log(tmp_path / n, g, k, n == "b.log") for n, k in (("a.log", 300), ("b.log", 40), ("c.log", 0))}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = parse_log_lines(read_log_lines(spark, f"file://{tmp_path}"))
        if split == 700:
            assert lines.select("path", "split").distinct().count() > 20
        d = text.log_records(lines, ["path"], "split", "at", "line", F.col("ts").isNotNull(), F.col("ts"), max_lines=10_000)
        got = {}
        for r in d.collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["record_no"], r["record_ts"], r["text"], r["n_lines"], r["part"]))
        for name, records in want.items():
            assert [(t, x) for _, t, x, _, _ in sorted(got[name])] == records
            assert all(n == x.count("\n") + 1 and p == 0 for _, _, x, n, p in got[name])
        # runs of long records: no line is lost and none is longer than the bound
        cut = text.log_records(lines, ["path"], "split", "at", "line", F.col("ts").isNotNull(), F.col("ts"), max_lines=100).collect()
        assert max(r["n_lines"] for r in cut) <= 100
        whole = sorted((r["record_no"], r["part"], r["text"], r["record_ts"]) for r in cut if r["path"].endswith("b.log") and r["record_no"] == 4)
        assert "\n".join(x for _, _, x, _ in whole) == want["b.log"][4][1] and len(whole) >= 40 and {t for *_, t in whole} == {want["b.log"][4][0]}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_of_null_and_empty_lines(spark):
    rows = [("f", 0, 1, None), ("f", 0, 2, ""), ("f", 1, 3, "2024-01-01 00:00:00 a"), ("f", 2, 4, None), (None, 0, 1, "2024-01-02 00:00:00 b"), (None, 0, 2, "c")]
    lines = parse_log_lines(spark.createDataFrame(rows, "file string, split long, at long, line string"))
    d = text.log_records(lines, ["file"], "split", "at", "line", F.col("ts").isNotNull(), F.col("ts"))
    got = sorted((r["file"] or "", r["record_no"], str(r["record_ts"]), r["n_lines"], r["text"]) for r in d.collect())
    assert got == [("", 1, "2024-01-02 00:00:00", 2, "2024-01-02 00:00:00 b\nc"), ("f", 0, "None", 2, "\n"),
                   ("f", 1, "2024-01-01 00:00:00", 2, "2024-01-01 00:00:00 a\n")]
    assert text.log_records(lines.limit(0), ["file"], "split", "at", "line", F.col("ts").isNotNull(), F.col("ts")).collect() == []


def test_recent_severity_comes_first(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    lines = spark.createDataFrame([(at(1), "Error: old"), (at(25), "Error: b"), (at(25), "Error: a"), (at(30), "Severity: 14"), (at(30), "fine"),
                                   (at(31), "Error: later"), (None, "Error: no time"), (at(24), "Error: bound")], "ts timestamp, line string")
    got = text.log_severity(lines, "line", [("error", "Severity: [12][0-9]"), ("error", "Error:")], ["ts"], ts="ts",
                            as_of=F.lit("2024-01-30 12:00:00").cast("timestamp"), days=7)
    assert [r["line"] for r in got.collect()] == ["Severity: 14", "Error: a", "Error: b", "Error: bound"]


def test_continuation_lines_have_the_time_of_their_record(spark):
    rows = [(1, "2024-01-30T01:00:00 begin"), (2, "ORA-00600: internal"), (3, "2020-01-01T01:00:00 long ago"), (4, "ORA-00601: old")]
    lines = view(spark, "host", "log_lines", [{"instance_id": "a", "source": "alert", "line_no": n, "line": x} for n, x in rows])
    got = run(ctx(spark, "host", {"log_lines": lines}), "H10").collect()
    assert [(r["line_no"], r["line"], r["is_abnormal"]) for r in got] == [(2, "ORA-00600: internal", True)]


# --- guaranteed rows ------------------------------------------------------------------------------------------

def test_guaranteed_rows(spark):
    spine = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, x int")
    rows = spark.createDataFrame([("a", 5, None), ("a", None, "t"), ("z", 9, "no")], "k string, n bigint, s string")
    out = relations.guaranteed_rows(spine, rows, ["k"], {"n": 0}, present="there")
    assert sorted(map(tuple, out.select("k", "n", "s", "there").collect()), key=repr) == sorted(
        [("a", 5, None, True), ("a", 0, "t", True), ("b", 0, None, False), ("c", 0, None, False)], key=repr)
    assert dict(out.dtypes)["n"] == "bigint"


def test_instances_without_rows_have_their_line(spark):
    var = view(spark, "mysql", "variables", [{"instance_id": i, "name": "server_id", "value": "1"} for i in "abc"] + [{"instance_id": "d", "name": "port", "value": "1"}])
    status = view(spark, "mysql", "status", [{"instance_id": "e", "name": "Uptime", "value": "5"}, {"instance_id": "a", "name": "Innodb_deadlocks", "value": "2"}])
    rep = view(spark, "mysql", "replica_status", [{"instance_id": "a", "channel": "", "io_running": "Yes", "sql_running": "Yes", "seconds_behind": 1},
                                                  {"instance_id": "b", "channel": "", "io_running": "No", "sql_running": "Yes"}])
    c = ctx(spark, "mysql", {"variables": var, "status": status, "replica_status": rep})
    got = {r["instance_id"]: (r["replica_state"], r["io_running"], r["is_abnormal"]) for r in run(c, "M06").collect()}
    assert got == {"a": ("OK", "Yes", False), "b": ("STOPPED", "No", True), "c": ("Not Configured", "N/A", False),
                   "d": ("Not Configured", "N/A", False), "e": ("Not Configured", "N/A", False)}
    got = {r["instance_id"]: (r["deadlocks"], r["print_all_deadlocks"], r["is_abnormal"]) for r in run(c, "M42").collect()}
    assert got["a"] == (2.0, "N/A", True) and got["d"] == (None, "N/A", False) and set(got) == set("abcde")


# --- abnormal lists -------------------------------------------------------------------------------------------

def findings(spark, rows):
    df = spark.createDataFrame(rows, "check_id string, key string, metric double, threshold double, red boolean, instance string")
    return fnd.union_findings([df.select(F.col("instance").alias("instance_id"), F.lit("e").alias("engine"), F.lit(None).cast("timestamp").alias("snapshot_ts"),
                                         "check_id", F.col("key").alias("object_key"), "metric", F.lit(None).cast("string").alias("metric_text"), "threshold",
                                         F.col("red").alias("is_abnormal"), F.lit(None).cast("string").alias("priority"), F.lit(None).cast("string").alias("advice"))])


def test_abnormal_list_equals_brute_force(spark):
    g = random.Random(8)
    rows = [(g.choice(["A", "B"]), g.choice([f"o{g.randint(0, 500)}", None]), g.choice([None, float(g.randint(-50, 50))]), g.choice([None, 10.0]), g.random() < 0.7, g.choice(["i", "j"]))
            for _ in range(900)] + [("hot", f"k{i:05d}", float(i), 0.0, True, "i") for i in range(3000)]
    got = fnd.abnormal_list(findings(spark, rows).repartition(7), ["instance_id", "check_id"], 4)
    want = {}
    for c, k, m, t, red, i in rows:
        if red:
            want.setdefault((i, c), []).append((m is None, -abs(m - (t or 0.0)) if m is not None else 0, k is None, k or "", m if m is not None else 0, (k, m)))
    want = {key: [x[-1] for x in sorted(v, key=lambda x: x[:-1])[:4]] for key, v in want.items()}
    assert {(r["instance_id"], r["check_id"]): [tuple(x) for x in r["abnormal_items"]] for r in got.collect()} == want


def test_abnormal_list_limits_before_its_shuffle(spark, capsys):
    fnd.abnormal_list(findings(spark, [("A", "k", 1.0, 0.0, True, "i")]), ["check_id"], 3).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out.split("Exchange")[-1]


def test_summary_carries_the_worst_and_the_checks_that_ran(spark):
    f = findings(spark, [("A", f"o{i}", float(i), 5.0, i > 7, "i") for i in range(20)] + [("B", "fine", 1.0, 5.0, False, "i")])
    ran = spark.createDataFrame([("A", None), ("B", None), ("C", None), ("D", "boom")], "check_id string, error string")
    pr = spark.createDataFrame([("A", "high", "act")], "check_id string, priority string, advice string")
    got = {r["check_id"]: (r["n_normal"], r["n_abnormal"], r["status"], [x["object_key"] for x in r["abnormal_items"]]) for r in
           fnd.health_summary(f, pr, ran=ran, worst=2).collect()}
    assert got == {"A": (8, 12, "abnormal", ["o19", "o18"]), "B": (1, 0, "normal", []), "C": (0, 0, "normal", []), "D": (0, 0, "error", [])}



def test_fingerprints_of_recent_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("2024-01-29T01:00:00.5+00:00 [ERROR] disk", "2024-01-29 02:00:00 [ERROR] disk", "2024-01-01 02:00:00 [ERROR] disk",
                                                  "  [ERROR] disk", "2024-01-30 12:00:01 [ERROR] later", None, "2024-01-30 12:00:00")], "line string")
    got = text.log_fingerprint(lines, "line", 5, strip=text.LEADING_TIMESTAMP, as_of=F.lit("2024-01-30 12:00:00").cast("timestamp"), days=7)
    # what is left of a zone belongs to the message, as the strip takes only the characters of a timestamp
    assert sorted((r["message"], r["n_lines"]) for r in got.collect()) == [("[ERROR] disk", 3)]
