"""The registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that define ``QUERIES`` and ``SQL``.
MODULES = ("files", "scalars", "aggregates", "joins", "windows", "texts", "rules", "reports", "more", "documents")


def _modules() -> list:
    return [import_module(f"calyx.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
