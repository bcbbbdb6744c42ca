"""Operators for training data; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("credentials", "cooccurrence", "handwritten", "docpairs", "parsing", "bpe", "leakage", "subjects")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out.update(import_module(f"{__name__}.{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(import_module(f"{__name__}.{m}").ORACLES)
    return out
