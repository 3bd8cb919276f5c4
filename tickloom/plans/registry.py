"""Collects the queries together with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a function ``(spark, folder) -> DataFrame`` under ``name``."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(build(spark, folder), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def present(df: DataFrame, digits: int) -> DataFrame:
    """Integers as bigint and doubles rounded: sums run in another order elsewhere."""
    shown = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (ByteType, ShortType, IntegerType)):
            column = column.cast("bigint").alias(field.name)
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            column = F.round(column.cast("double"), digits).alias(field.name)
        shown.append(column)
    return df.select(*shown)
