"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB's SQL.

Names begin with the ids of the operator inventory that they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "j05_asof_backward"


class Tables:
    """The tables of a folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from . import q_game, q_joins, q_labels, q_reports, q_sets, q_streams, q_windows  # noqa: E402, F401
