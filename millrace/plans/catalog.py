"""All registered queries of the core, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLES; a new query module is listed here.
MODULES: tuple[str, ...] = ("millrace.plans.scalar_queries", "millrace.plans.graph_queries", "millrace.plans.retrieval_queries", "millrace.plans.selection_queries", "millrace.plans.source_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out.update(import_module(m).QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(import_module(m).ORACLES)
    return out
