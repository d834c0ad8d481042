"""Query registry: name -> builder(spark, sf_dir) and, where SQL can express it, the
equivalent DuckDB SQL used as an independent oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

_MODULES = ["q_labels", "q_stats", "q_trends", "q_clean", "q_text", "q_learned", "q_sources"]


def query(name: str, sql: str | None = None):
    """Register a builder under ``name`` with its oracle SQL (None = rows-only check)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
