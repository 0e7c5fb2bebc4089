"""Per-DBMS check registries. Importing this package registers
every check in ``base.REGISTRY``."""

from . import base  # noqa: F401
from . import oracle  # noqa: F401

for _m in ("mysql", "postgres", "sqlserver", "host", "report"):
    try:
        __import__(f"{__name__}.{_m}")
    except ModuleNotFoundError as e:  # registry module not written yet
        if _m not in str(e):
            raise


def _apply_tiers_and_priorities():
    """One source of truth for report metadata: tiers from ``TIER_OF`` and
    priorities from the issue priority map (default medium)."""
    import dataclasses

    from .report import PRIORITY_MAP, TIER_OF
    prio = {cid: p for cid, p, _ in PRIORITY_MAP}
    for cid, c in list(base.REGISTRY.items()):
        base.REGISTRY[cid] = dataclasses.replace(c, tier=TIER_OF.get(cid, "weekly"),
                                                 priority=prio.get(cid, "medium"))


_apply_tiers_and_priorities()
