"""Every registered check EXECUTES (not only resolves) on non-empty synthetic
snapshot views: 2 instances x 2 collections x 6 rows per view, values
generated from each column's type and name. Catches runtime failures (ANSI
casts, overflow) that empty views cannot."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DayTimeIntervalType, DecimalType, DoubleType,
                               IntegerType, LongType, StringType, TimestampType)

from fleetcheck.plans.checks import base
from fleetcheck.schemas import VIEWS, schema

AS_OF = dt.datetime(2024, 1, 31)
DUMP = "\n".join(["cpuasge", "42", "", "freemem", "  total used free", "Mem: 100 60 40", "Swap: 0 0 0", "",
                  "diskusage", "** h1:", "Filesystem Type Size Used Avail Use% Mounted on",
                  "/dev/a xfs 1G 1G 0G 95% /", "", "sysctl", "vm.swappiness = 10", ""])
HTML = ('<span id="v">1</span><table id="t"><tr><th>a</th></tr><tr><td><font color="red">x</font></td></tr></table>')


def value_for(name: str, t, i: int):
    n = name.lower()
    if isinstance(t, StringType):
        if n in ("text",):
            return DUMP
        if n == "html":
            return HTML
        if n == "line":
            return f"2024-01-30T0{i}:00:00 0 [ERROR] [MY-{i % 2}] disk {i % 3}"
        if "lsn" in n:
            return f"0/{i + 16:X}000"
        if n == "rtime":
            return f"01/{20 + i}/2024 10:00:00"
        if n in ("status", "account_status", "state"):
            return ["VALID", "OPEN", "INVALID", "FAILED", "ONLINE", "NOT RUNNING"][i % 6]
        if any(k in n for k in ("value", "setting", "limit", "allocation", "version")):
            return str(i * 10)
        if n == "start_time":
            return "2024-01-01 00:00:00"
        if n == "name" or n.endswith("_name"):
            return ["processes", "sessions", "spfile", "cpu_count", "Uptime", "Questions"][i % 6]
        return f"{name}_{i % 3}"
    if isinstance(t, (IntegerType, LongType)):
        return (i * 7) % 50 + 1
    if isinstance(t, DecimalType):
        return Decimal(i * 1000 + 1)
    if isinstance(t, DoubleType):
        return i * 1.5 + 0.5
    if isinstance(t, TimestampType):
        return AS_OF - dt.timedelta(hours=i * 5 + 1)
    if isinstance(t, BooleanType):
        return i % 2 == 0
    if isinstance(t, BinaryType):
        return bytearray([120, 124, (i % 12) + 1, 1, 1, 1, 1])
    if isinstance(t, ArrayType):
        return ["all", f"x{i}"]
    if isinstance(t, DayTimeIntervalType):
        return dt.timedelta(minutes=10 * (i + 1))
    raise TypeError(t)


@pytest.fixture(scope="module")
def synthetic(spark):
    out = {}
    for engine, views in VIEWS.items():
        vs = {}
        for v in views:
            sch = schema(engine, v)
            rows = []
            for inst in ("i1", "i2"):
                for k, ts in enumerate((AS_OF - dt.timedelta(days=2), AS_OF - dt.timedelta(hours=1))):
                    for i in range(6):
                        vals = {"instance_id": inst, "engine": engine, "snapshot_ts": ts}
                        rows.append(tuple(vals[f.name] if f.name in vals else value_for(f.name, f.dataType, i + k)
                                          for f in sch.fields))
            vs[v] = spark.createDataFrame(rows, sch)
        out[engine] = vs
    return out


@pytest.mark.parametrize("cid", sorted(base.REGISTRY))
def test_check_runs_on_data(spark, synthetic, cid):
    c = base.REGISTRY[cid]
    ctx = base.Ctx(spark, synthetic[c.engine], F.lit(AS_OF).cast("timestamp"))
    c.fn(ctx).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("engine", sorted(VIEWS))
def test_findings_run_on_data(spark, synthetic, engine):
    ctx = base.Ctx(spark, synthetic[engine], F.lit(AS_OF).cast("timestamp"))
    f = base.run_findings(ctx, engine)
    if f is not None:
        rows = f.collect()
        assert all(r.check_id and r.is_abnormal is not None for r in rows)
