"""Registry of catalogue queries: name → (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparkfeat.sources.tables import read_table


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


_REGISTRY: dict[str, QuerySpec] = {}
_LOADED = False


def register(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = QuerySpec(name, fn, sql, ops)
        return fn
    return deco


class Tables:
    """Lazy accessor: ``t.lineitem`` reads ``<sf_dir>/lineitem.parquet``.

    Catalogue results are defined in UTC (the test timestamps are zone-less), so the
    session time zone is pinned to UTC for the catalogue queries.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self._spark, self._dir, name)


def _load_all():
    global _LOADED
    if not _LOADED:
        from sparkfeat.plans import (  # noqa: F401
            q_quality,
            q_transforms,
            q_model,
            q_store,
            q_drift_ab,
            q_metrics,
            q_validation,
            q_io,
            q_stream,
        )
        _LOADED = True


def specs() -> dict[str, QuerySpec]:
    _load_all()
    return dict(_REGISTRY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: s.build for n, s in specs().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s.sql for n, s in specs().items() if s.sql}
