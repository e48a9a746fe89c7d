"""Registry of the queries exposed through ``__spark_entry__``.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
The oracle SQL runs in DuckDB over the same parquet tables (registered as
views) and must return the same columns; both sides round floating results
to 6 decimals for the comparison only.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

MODULES = ("q_select", "q_vectors", "q_chat", "q_targets", "q_builders", "q_scoring", "q_io", "q_stream")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load():
    for m in MODULES:
        try:
            importlib.import_module(f"sieve.plans.{m}")
        except ModuleNotFoundError as exc:  # a module not written yet
            if exc.name != f"sieve.plans.{m}":
                raise


def queries() -> dict[str, Callable]:
    _load()
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def r6(c: Column | str) -> Column:
    """Round for comparison only (and fold -0.0 into 0.0)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


# SQL building blocks shared by the oracle queries (DuckDB dialect).
SQL_VECTORS = """
tv AS (SELECT vec_id AS target_id, label, embedding::DOUBLE[] AS v FROM embeddings
       WHERE vec_id IN (SELECT item_id FROM benchmark)),
pv AS (SELECT vec_id AS pool_id, label, embedding::DOUBLE[] AS v FROM embeddings
       WHERE vec_id NOT IN (SELECT item_id FROM benchmark)),
tn AS (SELECT target_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM tv),
pn AS (SELECT pool_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM pv),
scores AS (SELECT tn.target_id, pn.pool_id, list_dot_product(pn.v, tn.v) AS score FROM tn CROSS JOIN pn)
"""
