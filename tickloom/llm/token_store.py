"""Token ids in Parquet: list columns whose rows, pages and row groups can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import prepared, with_fields
from .text import portions
from .tokens import encoder, id_lists

#: Ids repeat, so they are dictionary encoded; the columns that describe a document are
#: delta encoded (version 2 pages). Column and offset indexes are written for all pages,
#: so a filter on doc_id reads single pages.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def encode(docs: DataFrame, vocabulary: str, end: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text, then ``end``; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for first, data, edges in portions(batch.column(1)):
                ids, counts = encode.closed(data, edges, end)
                names = batch.column(0).slice(first, len(counts))
                made = [pa.array(counts, pa.int64()), id_lists(ids, counts)]
                yield pa.RecordBatch.from_arrays([names, *made], names=schema.names)

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    schema = with_fields(rows.select("doc_id").schema, "n_tokens long, ids array<int>")
    return rows.mapInArrow(run, schema)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write a token store in ascending order of ids.

    The texts, not the longer lists of ids, are dealt out by ranges of the id; each task
    sorts its range and encodes as it writes. Null ids come first; rows that repeat an id
    are all written, in the order of their texts. Columns not named are not read.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode(ordered, vocabulary, end).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The store with each row's place: doc_id, n_tokens, ids, file, row."""
    stored = prepared(spark).read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    return stored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to rows with doc_id, n_tokens, file, row.

    Sums run inside each file, and the files' totals, one row a file, are added up in
    order. Ids are not read.
    """
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(F.asc_nulls_first("first")).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("total"))
    # nulls come first in the order: a file of them and of ids, if any, is the first one
    files = files.select("file", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    placed = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(files, "file").withColumn("start", F.col("start") + F.col("before")).drop("before")


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, file, row, n_tokens, ids_crc32) from the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            edges = lists.offsets.to_pylist()
            values = memoryview(lists.values.to_numpy()).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])]
            counts = [b - a for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    rows = stored.select("doc_id", "file", "row", "ids")
    return rows.mapInArrow(run, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
