"""All queries of the engine's own operators, with their SQL for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ["detection", "profiles", "clustering", "enrichment", "texts", "files", "studies"]


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {name: pair for area in AREAS for name, pair in import_module(f"kontra.plans.{area}").QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def positive_zero(sql: str) -> str:
    """Every round(...) with 0 added: Spark rounds small negative numbers to 0, DuckDB to -0."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        if m.start() < at:
            continue
        out += sql[at : m.start()] + "(" + sql[m.start() : i] + " + 0.0::DOUBLE)"
        at = i
    return out + sql[at:]


def oracle_sql() -> dict[str, str]:
    return {name: positive_zero(sql) for name, (_, sql) in _all().items() if sql}
