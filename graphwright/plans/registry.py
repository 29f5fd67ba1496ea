"""Registered queries: ``key -> (spark callable, DuckDB oracle or None)``.

Each callable takes ``(spark, sf_dir)``, reads the given tables (or fixtures
Spark derives from them) and returns a DataFrame.  Column names are aliased
identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[key] = (fn, oracle)
        return fn
    return deco


def queries() -> dict:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load_all():
    # importing the modules fills REGISTRY
    from . import q_relations, q_text, q_authority  # noqa: F401
    for mod in ("q_wikidata", "q_links", "q_entities", "q_replies", "q_questions",
                "q_sources", "q_streaming"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:  # module not written yet
            if mod not in str(e):
                raise
