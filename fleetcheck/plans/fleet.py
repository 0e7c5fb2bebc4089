"""Fleet run: every engine's checks over its snapshot views -> one findings
table -> per-instance health summary (R01)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fnd
from ..schemas import VIEWS, schema
from ..session import ensure_checkpoint_dir
from ..sources import read_snapshots
from ..sources.store import Views, collections, newest_collections
from .checks import base
from .checks.report import health_summary_of


def load_views(spark: SparkSession, root: str, engine: str, since: str | None = None,
               until: str | None = None, errors: dict | None = None, as_of: Column | None = None) -> Views:
    """Snapshot views of one engine stored under ``root/{engine}/{view}``
    (partitioned by snapshot_date), in their declared schemas; views without a folder were never collected and are
    skipped. Any other error is raised, or recorded in ``errors`` by view where that is given. With ``as_of`` the
    newest collections are found from the store's lines, pinned by a checkpoint of one row per view and instance."""
    out = {}
    for v in VIEWS[engine]:
        try:
            read_snapshots(spark, f"{root}/{engine}", v)  # unreadable files show here: a schema of our own asks no file
            out[v] = read_snapshots(spark, f"{root}/{engine}", v, since, until, schema=schema(engine, v))
        except Exception as e:  # noqa: BLE001 - sorted out below
            if isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND":
                continue
            if errors is None:
                raise
            errors[v] = str(e).splitlines()[0][:500]
    if as_of is None or not any("slice" in df.columns for df in out.values()):
        return Views(out)
    ensure_checkpoint_dir(spark)
    lines = collections(spark, f"{root}/{engine}")
    if since is not None:
        lines = lines.filter(F.col("snapshot_date") >= F.lit(since).cast("date"))
    if until is not None:
        lines = lines.filter(F.col("snapshot_date") <= F.lit(until).cast("date"))
    return Views(out, newest_collections(lines, as_of).checkpoint(eager=True))


@dataclass
class Built:
    """One engine's checks as plans: built once, used for the findings, for what was due, and check by check."""
    ctx: base.Ctx
    results: dict[str, DataFrame]
    failed: dict[str, str]


def build(spark: SparkSession, views_by_engine: Mapping[str, Mapping[str, DataFrame]], as_of: Column,
          tier: str | None = None, materialize: bool = False) -> dict[str, Built]:
    out = {}
    for engine, views in views_by_engine.items():
        ctx = base.Ctx(spark, views, as_of)
        if materialize:
            ctx.materialize()
        out[engine] = Built(ctx, *base.run_checks(ctx, engine, tier=tier))
    return out


def checks_ran(spark: SparkSession, views_by_engine: Mapping[str, Mapping[str, DataFrame]], as_of: Column, tier: str | None = None,
               unreadable: Mapping[str, Mapping[str, str]] | None = None, built: Mapping[str, Built] | None = None) -> DataFrame:
    """(instance_id, check_id, error): the checks with a verdict that were due, for each instance of their engine that
    has a collection. error: why a check could not be built, or that a view it needs could not be read."""
    engines = sorted({*views_by_engine, *(unreadable or {})})
    if built is None:
        built = build(spark, {e: views_by_engine.get(e, {}) for e in engines}, as_of, tier)
    out = spark.createDataFrame([], "instance_id string, check_id string, error string")
    for engine in engines:
        b = built.get(engine) or build(spark, {engine: {}}, as_of, tier)[engine]
        broken = (unreadable or {}).get(engine, {})
        due = {c: None for c, df in b.results.items() if "is_abnormal" in df.columns}
        for c, message in b.failed.items():
            lost = [f"{v}: {broken[v]}" for v in base.REGISTRY[c].inputs if v in broken]
            if lost or not message.startswith("missing input"):
                due[c] = "; ".join(lost) or message
        if not due:
            continue
        each = F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(e).cast("string").alias("error")) for c, e in sorted(due.items())])
        out = out.unionByName(b.ctx.instances().select("instance_id", F.inline(each)))
    return out


def fleet_findings(spark: SparkSession, views_by_engine: Mapping[str, Mapping[str, DataFrame]], as_of: Column,
                   tier: str | None = None, materialize: bool = False, built: Mapping[str, Built] | None = None) -> DataFrame:
    """Findings of every engine's applicable checks. ``materialize`` pins each
    view's latest collection with a reliable checkpoint first (large fleets)."""
    built = built or build(spark, views_by_engine, as_of, tier, materialize)
    frames = [base.findings_of(b.ctx, b.results) for b in built.values()]
    return fnd.union_findings([f for f in frames if f is not None])


def fleet_summary(spark: SparkSession, views_by_engine, as_of: Column, tier: str | None = None,
                  out_path: str | None = None, materialize: bool = False, unreadable=None):
    """(findings, summary). With ``out_path`` (a shared folder) the findings
    are written there first, partitioned by engine and check, and the summary
    reads the written table: the lineage of ~190 check plans is cut and a lost
    executor only recomputes its own check. Every check that was due has a line in the summary, also without
    findings; ``unreadable`` maps engine -> view -> error, as load_views records them."""
    built = build(spark, views_by_engine, as_of, tier, materialize)
    f = fleet_findings(spark, views_by_engine, as_of, tier, built=built)
    if out_path is not None:
        f.write.mode("overwrite").partitionBy("engine", "check_id").parquet(out_path)
        f = spark.read.parquet(out_path)
    return f, health_summary_of(f, spark, checks_ran(spark, views_by_engine, as_of, tier, unreadable, built))


def as_of_ts(ts: str) -> Column:
    return F.lit(ts).cast("timestamp")


def write_findings_isolated(spark: SparkSession, views_by_engine, as_of: Column, out_path: str,
                            tier: str | None = None, built: Mapping[str, Built] | None = None) -> DataFrame:
    """Per-check isolation (the reference's per-section TRY/CATCH): each
    check's findings are written as their own job into ``out_path``
    (partitioned by engine and check_id); a check that fails while building
    or running is recorded and the others still run. Returns the errors as a
    DataFrame (instance_id NULL, check_name, error) — the run-errors view."""
    errors = []
    for engine, b in (built or build(spark, views_by_engine, as_of, tier)).items():
        errors += [(cid, msg) for cid, msg in b.failed.items() if not msg.startswith("missing input")]
        for cid, df in b.results.items():
            f = base.findings_of(b.ctx, {cid: df}) if "is_abnormal" in df.columns else None
            if f is None:
                continue
            try:
                (f.drop("engine", "check_id").write.mode("overwrite")
                  .parquet(f"{out_path}/engine={engine}/check_id={cid}"))
            except Exception as e:  # noqa: BLE001 - isolate one check's runtime failure
                errors.append((cid, str(e).splitlines()[0][:500]))
    return spark.createDataFrame([(None, c, m) for c, m in errors],
                                 "instance_id string, check_name string, error string")
