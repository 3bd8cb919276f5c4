"""What the operators of this package share on the Spark side."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import stage

ROOT = str(Path(__file__).resolve().parents[2])

__all__ = ["no_clash", "prepared", "stage", "table", "with_fields"]


#: Size of an Arrow batch, unless the session names one. The default is 64 MB, which both
#: sides of a Python task hold several times over, outside the heap.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it, in small Arrow batches."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def with_fields(schema: StructType, more: str) -> StructType:
    """``schema`` followed by the fields of a DDL string."""
    return StructType(schema.fields + StructType.fromDDL(more).fields)


def no_clash(carry: Iterable[str], added: Iterable[str]) -> None:
    """Refuse carried columns that are named like a column of the result."""
    both = sorted({*carry} & {*added})
    if both:
        raise ValueError(f"carried columns clash with the result: {both}; rename them first")
