"""Packed tables hold the ids of their sequences."""

from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
from tickloom.llm.common import table
from tickloom.llm.queries import QUERIES, vocabulary
from tickloom.session import staging_root

from . import plain

SMALL = "/root/testdata/sf0.001"


def wanted(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    return {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}


def test_the_last_stage_of_the_pipeline_holds_its_ids(spark):
    docs = table(spark, SMALL, "documents")
    ids = {}
    for r in sorted(corpus_pipeline.packing(spark, docs, SMALL).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == wanted(docs)


def test_packing_digests_come_from_written_ids(spark):
    rows = QUERIES["op10_packing"](spark, SMALL).collect()
    folders = Path(urlparse(staging_root(spark)).path).glob("packed-*")
    written = {(r.sequence_id, r.offset): r.ids for r in spark.read.parquet(str(max(folders, key=lambda f: f.stat().st_mtime))).collect()}
    assert len(written) == len(rows)
    assert all(r.ids_crc32 == plain.crc(written[r.sequence_id, r.offset]) for r in rows)
