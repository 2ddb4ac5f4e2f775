"""How a query is registered: its columns, the Spark job and the SQL that must agree.

A column list is text like ``"id:i name:s value:d4"``: i = BIGINT, s = text, b = BOOLEAN,
d<n> = DOUBLE rounded to n places, x = DOUBLE as it is. Both sides are cast and rounded by the same list.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean", "x": "double"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "x": "DOUBLE"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _spark_column(name: str, kind: str):
    if kind[0] == "d":
        # adding 0.0 turns -0.0 into 0.0
        return (F.round(F.col(name).cast("double"), int(kind[1:] or 6)) + F.lit(0.0)).alias(name)
    return F.col(name).cast(_SPARK[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind[0] == "d":
        return f'round(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS {_SQL[kind]}) AS "{name}"'


def query(spec: str, sql: str | None = None):
    """Register ``function(spark, folder)`` under its own name."""
    def register(function):
        columns = _columns(spec)

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(spark, folder).select(*[_spark_column(n, k) for n, k in columns])

        name = function.__name__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            shown = ", ".join(_sql_column(n, k) for n, k in columns)
            body = sql.strip()
            ORACLES[name] = f"SELECT {shown} FROM ({body}) AS answer"
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
