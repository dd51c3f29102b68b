"""Registry of queries: name -> (Spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. Computed columns carry the same names in both forms and
doubles are rounded to 6 places in both, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # importing the modules fills the registry
    from litspark.plans import (q_text, q_filters, q_joins, q_aggs, q_windows,  # noqa: F401
                                q_sampling, q_terms, q_vectors, q_eval, q_io)
    return REGISTRY
