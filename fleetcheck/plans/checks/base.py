"""Check registry: id -> inputs, operator calls, thresholds, priority, tier.

A check is a function ``(ctx) -> DataFrame`` over snapshot views of one
engine. Every view carries the envelope ``(instance_id, engine,
snapshot_ts)``; ``ctx.cur(view)`` keeps each instance's latest collection at
or before ``as_of``, so checks are deterministic and back-fillable. Checks
with a verdict return ``is_abnormal``; ``run_findings`` projects them to the
findings contract. Each check is an independent lazy plan: a failing check is
recorded in ``errors`` and the others still run (the per-section TRY/CATCH
of the reference).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import findings as fnd
from ...sources import union_all
from ...sources.store import Views

K = ["instance_id"]


@dataclass(frozen=True)
class Check:
    check_id: str
    engine: str
    name: str
    inputs: tuple
    fn: Callable
    key: tuple = ()          # columns forming the findings object_key
    metric: str | None = None
    threshold: float | None = None
    priority: str = "medium"
    tier: str = "weekly"     # weekly / monthly / quarterly report depth
    min_version: int | None = None
    max_version: int | None = None
    instead: tuple = ()      # other sets of inputs that will do: views that a collector has joined already


REGISTRY: dict[str, Check] = {}


def check(check_id: str, engine: str, name: str, inputs, key=(), metric=None, threshold=None,
          priority="medium", tier="weekly", min_version=None, max_version=None, instead=()):
    def deco(fn):
        REGISTRY[check_id] = Check(check_id, engine, name, tuple(inputs), fn, tuple(key), metric, threshold,
                                   priority, tier, min_version, max_version, tuple(map(tuple, instead)))
        return fn
    return deco


@dataclass
class Ctx:
    spark: SparkSession
    views: Mapping[str, DataFrame]
    as_of: Column
    params: dict = field(default_factory=dict)
    _cur: dict = field(default_factory=dict, repr=False)

    def v(self, name: str) -> DataFrame:
        return self.views[name]

    def has(self, *names: str) -> bool:
        return all(n in self.views for n in names)

    def cur(self, name: str) -> DataFrame:
        """Latest collection of a view per instance at or before ``as_of``.
        Views of the snapshot store know theirs (``sources.store``): one scan
        pruned to the newest partitions. Other frames find the newest instant
        from their rows, one row per instance (a bounded side). The envelope's
        engine/snapshot_ts are dropped so views join on K cleanly.
        Memoised: every check of a run shares one plan per view."""
        if name not in self._cur:
            if isinstance(self.views, Views) and self.views.registered(name):
                self._cur[name] = self.views.current(name).drop("engine", "snapshot_ts", "snapshot_date", "slice")
            else:
                df = self.views[name].filter(F.col("snapshot_ts") <= self.as_of)
                last = df.groupBy("instance_id").agg(F.max("snapshot_ts").alias("_last"))
                self._cur[name] = (df.join(last, "instance_id")
                                     .filter(F.col("snapshot_ts") == F.col("_last"))
                                     .drop("_last", "engine", "snapshot_ts"))
        return self._cur[name]

    def instances(self) -> DataFrame:
        """(instance_id) of every instance with a collection at or before ``as_of``."""
        if isinstance(self.views, Views) and self.views.newest is not None:
            return self.views.newest.select("instance_id").distinct()
        held = [v.filter(F.col("snapshot_ts") <= self.as_of).select("instance_id") for v in self.views.values()]
        return union_all(held or [self.spark.createDataFrame([(None,)], "instance_id string")]).distinct()

    def memo(self, name: str, build):
        """One DataFrame per derived frame per run (snapshot pair, wide
        status, parsed OS sections): checks share a plan instead of rebuilding."""
        key = "memo:" + name
        if key not in self._cur:
            self._cur[key] = build()
        return self._cur[key]

    def materialize(self, names=None) -> None:
        """Pin the latest collections before running many checks: a reliable
        ``checkpoint()`` into the shared ``spark.checkpoint.dir`` (survives
        executor loss, cuts the lineage every check would otherwise replay)."""
        from ...session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        for n in names or list(self.views):
            self._cur[n] = self.cur(n).checkpoint(eager=True)

    def p(self, name, default):
        return self.params.get(name, default)


def checks_for(engine: str | None = None, tier: str | None = None) -> list[Check]:
    tiers = {"weekly": 0, "monthly": 1, "quarterly": 2}
    out = [c for c in REGISTRY.values() if engine is None or c.engine == engine]
    if tier is not None:
        out = [c for c in out if tiers[c.tier] <= tiers[tier]]
    return sorted(out, key=lambda c: c.check_id)


def applies(c: Check, version: int | None) -> bool:
    """Version gating: checks that exist only in some DBMS major versions."""
    if version is None:
        return True
    return (c.min_version is None or version >= c.min_version) and (c.max_version is None or version <= c.max_version)


def run_checks(ctx: Ctx, engine: str | None = None, ids=None, tier: str | None = None):
    """Build every applicable check lazily; returns (results, errors).
    ``ctx.params["version"]`` (DBMS major version) gates version-specific checks."""
    results, errors = {}, {}
    for c in checks_for(engine, tier):
        if ids is not None and c.check_id not in ids:
            continue
        if not applies(c, ctx.params.get("version")):
            continue
        if not any(ctx.has(*views) for views in (c.inputs, *c.instead)):
            errors[c.check_id] = "missing input: " + ",".join(i for i in c.inputs if i not in ctx.views)
            continue
        try:
            results[c.check_id] = c.fn(ctx)
        except Exception as e:  # noqa: BLE001 - isolate one check's failure
            errors[c.check_id] = str(e)[:500]
    return results, errors


def run_findings(ctx: Ctx, engine: str | None = None, ids=None, tier: str | None = None) -> DataFrame:
    """Union of the findings of every check with a verdict column."""
    return findings_of(ctx, run_checks(ctx, engine, ids, tier)[0])


def findings_of(ctx: Ctx, results: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the findings of built checks, by id, that have a verdict column."""
    frames = []
    for cid, df in results.items():
        c = REGISTRY[cid]
        if "is_abnormal" not in df.columns:
            continue
        # objects outside containers (0) are named without one
        parts = [F.when(F.col(k) > 0, F.col(k).cast("string")) if k == "con_id" else F.col(k).cast("string") for k in c.key]
        key = F.concat_ws("|", *parts) if parts else F.lit(c.name)
        metric = F.col(c.metric) if c.metric else None
        frames.append(fnd.to_findings(df, cid, key, metric, c.threshold,
                                      instance_id=F.col("instance_id") if "instance_id" in df.columns else None,
                                      engine=c.engine, snapshot_ts=ctx.as_of))
    return fnd.union_findings(frames)


def priorities_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.check_id, c.priority, c.name) for c in REGISTRY.values()],
                                 "check_id string, priority string, advice string")
