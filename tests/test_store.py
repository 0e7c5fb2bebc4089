"""The snapshot store: repeatable writes, newest collections from the store's lines, pruned scans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from fleetcheck.plans import fleet
from fleetcheck.plans.checks import base
from fleetcheck.sources import collect_views, write_snapshots
from fleetcheck.sources.store import Views, collections, newest_collections
from fleetcheck.schemas import schema

AS_OF = "2024-01-31 00:00:00"
E = "oracle"
COLUMNS = "tablespace_name string, contents string, total_bytes bigint, used_bytes bigint, n_files int"


def rows_of(spark, *used):
    return spark.createDataFrame([(f"T{i}", "PERMANENT", 100, u, 1) for i, u in enumerate(used)], COLUMNS)


def collect(spark, root, instance, ts, *used):
    collect_views({"tablespaces": rows_of(spark, *used)}, root, E, instance, ts)


def current(spark, root, as_of=AS_OF, **kw):
    views = fleet.load_views(spark, root, E, as_of=fleet.as_of_ts(as_of), **kw)
    return base.Ctx(spark, views, fleet.as_of_ts(as_of))


def used(ctx):
    return sorted((r["instance_id"], r["tablespace_name"], r["used_bytes"]) for r in ctx.cur("tablespaces").collect())


def test_writing_twice_leaves_all_counts_equal(spark, tmp_path):
    root = str(tmp_path)
    for _ in range(2):  # a retried collection
        collect(spark, root, "a", "2024-01-30 06:00:00", 1, 2, 3)
        collect(spark, root, "b", "2024-01-30 07:00:00", 4)
        collect(spark, root, "a", "2024-01-29 06:00:00", 9)
    held = spark.read.parquet(f"{root}/{E}/tablespaces")
    assert held.count() == 5
    lines = collections(spark, f"{root}/{E}")
    assert sorted((r["instance_id"], str(r["snapshot_ts"]), r["n_rows"]) for r in lines.collect()) == [
        ("a", "2024-01-29 06:00:00", 1), ("a", "2024-01-30 06:00:00", 3), ("b", "2024-01-30 07:00:00", 1)]
    collect(spark, root, "a", "2024-01-30 06:00:00", 7, 8)  # the same collection again, with other rows
    assert used(current(spark, root)) == [("a", "T0", 7), ("a", "T1", 8), ("b", "T0", 4)]


def test_many_instances_in_one_write_replace_only_themselves(spark, tmp_path):
    sch = schema(E, "tablespaces")
    at = [dt.datetime(2024, 1, 28, 1), dt.datetime(2024, 1, 30, 1)]

    def batch(used, instances):
        return spark.createDataFrame([(f"i{i}", E, t, f"T{k}", "PERMANENT", 100, used, 1, None) for i in instances for t in at for k in range(i)], sch)

    write_snapshots(batch(1, range(1, 7)), f"{tmp_path}/{E}", "tablespaces")
    write_snapshots(batch(2, [3, 5]), f"{tmp_path}/{E}", "tablespaces")
    got = used(current(spark, str(tmp_path)))
    assert got == sorted((f"i{i}", f"T{k}", 2 if i in (3, 5) else 1) for i in range(1, 7) for k in range(i))
    assert spark.read.parquet(f"{tmp_path}/{E}/tablespaces").count() == 2 * sum(range(1, 7))


def test_an_empty_newest_collection_has_no_current_rows(spark, tmp_path):
    root = str(tmp_path)
    collect(spark, root, "a", "2024-01-29 06:00:00", 95)
    collect(spark, root, "b", "2024-01-29 06:00:00", 50)
    collect(spark, root, "a", "2024-01-30 06:00:00")  # nothing found this time
    assert used(current(spark, root)) == [("b", "T0", 50)]
    assert used(current(spark, root, as_of="2024-01-29 12:00:00")) == [("a", "T0", 95), ("b", "T0", 50)]
    assert used(current(spark, root, as_of="2024-01-01 00:00:00")) == []
    collect(spark, root, "b", "2024-01-29 06:00:00")  # written again, without rows
    assert used(current(spark, root)) == []
    assert sorted(r[0] for r in current(spark, root).instances().collect()) == ["a", "b"]  # both were collected all the same


def test_one_scan_a_view_with_partition_filters(spark, tmp_path, capsys):
    root = str(tmp_path)
    for day in (1, 3, 28, 29, 30):
        collect(spark, root, "a", f"2024-01-{day:02d} 06:00:00", day)
    collect(spark, root, "gone", "2024-01-03 06:00:00", 3)
    ctx = current(spark, root)
    ctx.cur("tablespaces").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == 2  # in the tree and in its details
    filters = re.search(r"PartitionFilters: .*", plan)[0]
    assert "2024-01-30" in filters and "2024-01-03" in filters and "2024-01-29" not in filters
    assert "dynamicpruningexpression(slice" in filters
    assert used(ctx) == [("a", "T0", 30), ("gone", "T0", 3)]


def test_rows_of_older_collections_are_never_read(spark, tmp_path):
    root = str(tmp_path)
    collect(spark, root, "a", "2024-01-30 06:00:00", 1)
    collect(spark, root, "b", "2024-01-30 09:00:00", 2)
    collect(spark, root, "b", "2024-01-30 08:00:00", 3)  # the same date: only the slice tells
    folders = [p for p in (tmp_path / E / "tablespaces").rglob("slice=b@*") if str(int(dt.datetime(2024, 1, 30, 8, tzinfo=dt.timezone.utc).timestamp())) in p.name]
    assert len(folders) == 1
    views = fleet.load_views(spark, root, E, as_of=fleet.as_of_ts(AS_OF))
    for f in folders[0].glob("*.parquet"):
        f.write_bytes(b"lost")
    for f in folders[0].glob(".*.crc"):
        f.unlink()
    assert used(base.Ctx(spark, views, fleet.as_of_ts(AS_OF))) == [("a", "T0", 1), ("b", "T0", 2)]


def test_older_files_lack_newer_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", E, dt.datetime(2024, 1, 30, 6), "T0", 5)],
                                 "instance_id string, engine string, snapshot_ts timestamp, tablespace_name string, used_bytes bigint")
    write_snapshots(rows, f"{tmp_path}/{E}", "tablespaces")
    collect(spark, str(tmp_path), "b", "2024-01-30 06:00:00", 1)
    ctx = current(spark, str(tmp_path))
    assert sorted((r["instance_id"], r["contents"]) for r in ctx.cur("tablespaces").collect()) == [("a", None), ("b", "PERMANENT")]


def test_lines_cover_every_view_and_bound(spark, tmp_path):
    root = str(tmp_path)
    collect_views({"tablespaces": rows_of(spark, 1), "registry": spark.createDataFrame([("CATALOG", "VALID")], "comp_id string, status string")},
                  root, E, "a", "2024-01-30 06:00:00")
    nameless = rows_of(spark, 4).selectExpr("cast(null as string) as instance_id", "'oracle' as engine", "timestamp'2024-01-30 06:00:00' as snapshot_ts", "*")
    write_snapshots(nameless, f"{root}/{E}", "tablespaces", nameless)  # an instance without a name is one instance
    newest = newest_collections(collections(spark, f"{root}/{E}"), F.lit(AS_OF).cast("timestamp"))
    assert sorted((r["view"], r["instance_id"] or "", r["n_rows"]) for r in newest.collect()) == [
        ("registry", "a", 1), ("tablespaces", "", 1), ("tablespaces", "a", 1)]
    assert used(current(spark, root, since="2024-01-31")) == []
    assert collections(spark, f"{root}/mysql").count() == 0
    _, s = fleet.fleet_summary(spark, {E: fleet.load_views(spark, root, E, as_of=fleet.as_of_ts(AS_OF))}, fleet.as_of_ts(AS_OF))
    got = {(r["instance_id"], r["check_id"]): r["status"] for r in s.collect()}
    assert got[("a", "O13")] == "normal" and got[("a", "O22")] == "normal"


def test_checks_are_built_once(spark):
    calls = []

    @base.check("Z97", E, "counts_its_builds", ["tablespaces"])
    def z97(ctx):
        calls.append(1)
        return ctx.cur("tablespaces").withColumn("is_abnormal", F.lit(False))

    try:
        ts = rows_of(spark, 1).selectExpr("'a' as instance_id", "'oracle' as engine", "timestamp'2024-01-30 06:00:00' as snapshot_ts", "*")
        _, s = fleet.fleet_summary(spark, {E: Views({"tablespaces": ts})}, fleet.as_of_ts(AS_OF))
        assert [r["status"] for r in s.collect() if r["check_id"] == "Z97"] == ["normal"] and len(calls) == 1
    finally:
        base.REGISTRY.pop("Z97", None)


@pytest.mark.parametrize("flag", [[], ["--one-job"]])
def test_command_line_records_a_failing_check(spark, tmp_path, flag):
    from fleetcheck.__main__ import main

    @base.check("Z96", E, "fails_at_run_time", ["tablespaces"])
    def z96(ctx):
        return ctx.cur("tablespaces").withColumn("is_abnormal", F.raise_error(F.lit("boom")).isNull())

    try:
        root, out = f"{tmp_path}/store", f"{tmp_path}/out"
        collect(spark, root, "a", "2024-01-30 06:00:00", 95)
        args = ["--root", root, "--as-of", AS_OF, "--out", out, "--engines", E, *flag]
        if flag:
            with pytest.raises(Exception, match="boom"):
                main(args)
            return
        assert main(args)["check_errors"] == 1
        got = {r["check_id"]: (r["status"], r["n_abnormal"]) for r in spark.read.parquet(f"{out}/summary").collect()}
        assert got["Z96"][0] == "error" and got["O22"] == ("abnormal", 1)
    finally:
        base.REGISTRY.pop("Z96", None)
