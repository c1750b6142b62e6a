"""Query catalogue: name -> Spark builder and (optionally) its DuckDB twin.

Builders take (spark, sf_dir) and return a DataFrame over the given tables.
A missing SQL twin marks a query checked by invariants / row counts only
(trained models, random or iterative work, streams compared to batch).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.sources.tables import table


@dataclass
class Plan:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, ids=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate plan {name}")
        REGISTRY[name] = Plan(name, fn, sql, tuple(ids))
        return fn
    return deco


class Tables:
    """Lazy access to the given tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)
