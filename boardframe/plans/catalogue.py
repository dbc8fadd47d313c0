"""Where queries and the SQL that gives the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a reader of tables under its name."""

    def add(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[make.__name__] = run
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add
