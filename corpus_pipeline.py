"""From raw documents to packed sequences: five stages, each written and read again.

Quality rules drop documents, near dedup keeps one of each group, substring dedup and
benchmark decontamination cut words out, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import prepared, stage, table
from tickloom.llm.decontaminate import find_contamination, remove_spans
from tickloom.llm.minhash import ID_LIMIT, near_duplicates
from tickloom.llm.packing import pack
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.queries import vocabulary
from tickloom.llm.substrings import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    prepared(spark)
    return quality_rules(docs, carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8.

    Rows are documents. Where ids repeat or are null, rows are told apart by id and digest
    of the text, so a text goes only if it has copies itself; of equal rows one stays.
    """
    prepared(spark)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return _without(docs, near_duplicates(docs, size=5, percent=80), "doc_id")
    rows = docs.withColumn("row", _row_name())
    copies = stage(rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row"), "copies")
    once = rows.join(copies, "row", "left_semi").dropDuplicates(["row"])
    rows = stage(rows.join(copies, "row", "left_anti").unionByName(once), "rows")
    return _without(rows, near_duplicates(rows, size=5, percent=80, id_column="row"), "row")


def _row_name():
    """Id and digest of the text as a string that sorts as the id does, null first."""
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat_ws("-", F.coalesce(number, F.lit("")), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def _without(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The rows that their group keeps."""
    gone = stage(groups.filter("NOT kept").select(key).distinct(), "gone")
    if gone.count() <= ID_LIMIT:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 13 words of earlier documents are cut; documents of which nothing is left go."""
    prepared(spark)
    done = substring_dedup(docs, carry=("lang", "source", "n_chars"))
    some = done.filter("n_removed = 0 OR n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return some.select("doc_id", F.col("kept").alias("text"), "lang", "source", length.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly such passages go."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    cut = remove_spans(found)
    length = F.when(F.size("hits") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of at most 4096 tokens."""
    prepared(spark)
    return pack(docs, vocabulary(), end=2)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("substring dedup", substrings),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL cannot state compression ratios or token ids; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
