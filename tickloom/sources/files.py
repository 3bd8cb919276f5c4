"""Readers and writers. All of them take explicit schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.reshape import bind_rows, rename_positional
from ..schemas import NA_TOKENS


def scan_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """A CSV file, some, or a directory of part files with one schema. Lazy and uncached.

    A header with other names, or the same in another order, fails.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("mode", "FAILFAST").csv(path)


def scan_csv_parts(spark: SparkSession, parts: Sequence[tuple[str, StructType | str]]) -> DataFrame:
    """Part files with different columns, bound together by name."""
    return bind_rows(*[scan_csv(spark, path, schema) for path, schema in parts])


def scan_csv_directory(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All part files of a directory, whatever the order of their columns, bound by name.

    The first line of each file is read for its header. What reaches the driver is one row
    per file; files with equal headers are then read together. Columns that a
    file lacks are NULL, columns that ``schema`` lacks fail. Headers are bare names
    separated by commas.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    firsts = lines.select(F.col("_metadata.file_path").alias("file"), place.alias("at"), "value")
    heads = firsts.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    parts = []
    for header, files in groups.collect():
        names = [n.strip().strip('"') for n in header.split(",")]
        unknown = sorted(set(names) - set(wanted.names))
        if unknown:
            raise ValueError(f"columns {unknown} of {files[0]} are not in the schema")
        own = StructType([wanted[n] for n in names])
        parts.append(scan_csv(spark, files, own))
    bound = bind_rows(spark.createDataFrame([], wanted), *parts)
    return bound.select(*wanted.names)


def number_or_null(text: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Text -> double; any of the given spellings means missing, other text fails."""
    kept = F.when(~F.trim(text).isin(*tokens), text)
    return kept.cast("double")


def scan_na_tokens(
    spark: SparkSession, path: str, names: Sequence[str], tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """A CSV of one date column and numeric columns with several spellings of NA.

    Columns are named by position, whatever the header says.
    """
    text = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", True).csv(path)
    date, *numbers = names
    named = rename_positional(raw, names)
    return named.select(
        F.to_date(date).alias(date), *[number_or_null(F.col(c), tokens).alias(c) for c in numbers]
    )


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``. Rows of one partition value are brought
    together first, split by size, so that every value gets a few large files."""
    out = df
    if partition_by:
        out = df.hint("rebalance", *[F.col(c) for c in partition_by])
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def sink_checked(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), **checks: Column
) -> tuple[dict[str, int], dict[str, int]]:
    """Replace the table at ``path`` and measure it on the way, in the same job.

    Gives the number of missing values per column, and ``rows`` and the number of rows that
    pass each of ``checks``. The metrics are taken where the rows are written, behind any
    shuffle, so a task that runs again does not count twice.
    """
    seen = Observation()
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in df.columns]
    passed = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"passed {name}") for name, c in checks.items()]
    out = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), *missing, *passed)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    found = seen.get
    counts = {"rows": found["rows"], **{name: found[f"passed {name}"] for name in checks}}
    return {c: found[f"missing {c}"] for c in df.columns}, counts


def sink_bucketed(
    df: DataFrame, name: str, path: str, by: Sequence[str], sort: Sequence[str], buckets: int
) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets of ``by``, each one file sorted by ``sort``, and go on from it.

    The table is known to the session's catalog as ``name``. Joins and windows by ``by`` or
    by more columns run on it without an exchange: the shuffle is paid once, by the write.
    """
    placed = df.repartition(buckets, *by).sortWithinPartitions(*by, *sort)
    writer = placed.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *by).sortBy(*sort).saveAsTable(name)
    return df.sparkSession.table(name)


def sink_csv_overwrite(df: DataFrame, path: str) -> None:
    """Write CSV part files with a header in place of whatever is at ``path``."""
    df.write.mode("overwrite").option("header", True).csv(path)
