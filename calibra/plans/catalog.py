"""All named queries in one place. Importing the modules registers them."""

from __future__ import annotations

from calibra.plans import queries_classes, queries_metrics, queries_scoring, queries_tables  # noqa: F401
from calibra.plans.registry import BUILDERS, ORACLES, Builder


def all_queries() -> dict[str, Builder]:
    return dict(BUILDERS)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
