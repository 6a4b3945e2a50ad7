"""All queries of the spatial engine with their oracle SQL."""

from __future__ import annotations

from arealis.plans import calculator, details, files, spatial, views  # noqa: F401
from arealis.plans.base import REGISTRY


def queries() -> dict:
    return {name: run for name, (run, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
