"""Registry of this subpackage's queries: name → (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfeat.llm.common import ship_package

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def put(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)
        _QUERIES[name] = (run, sql)
        return run
    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sparkfeat.llm import queries as _  # noqa: F401
    return {k: build for k, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from sparkfeat.llm import queries as _  # noqa: F401
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
