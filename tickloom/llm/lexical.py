"""Ranked lexical search: items against all documents, terms dealt out to owners in a pipeline.

One scan turns the documents into shards: for some thousands of documents the postings of
the items' terms. Terms are then dealt to owners by falling weight, and the shards pass the
owners one after the other: in each step a cogroup brings the bundle of items, with the
integer scores that its documents have so far, to the postings of the next owner, which
adds what its terms contribute. After the last owner every shard gives its best documents
for each item, and the best of these are the result.

Scores are sums of integers that are not negative. So a document whose score cannot reach
the tenth best of its shard, even with all that later terms could add, is left out of the
accumulators without a change to the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepared, stage, with_fields
from .text import Stretch, alphanumeric, short_keys, stretches
from .tokens import Table

#: Documents, and about how many postings, in a shard.
SHARD_DOCUMENTS, SHARD_POSTINGS = 4096, 1 << 20
#: Items whose accumulators are in memory at once.
BUNDLE = 512
#: Terms, with repeats in other items, of the items that are searched for in one pass over the
#: documents (some 10 MB to broadcast); more items take several passes.
PASS_TERMS = 300_000
#: Share of all postings up to which terms, by falling weight, go to each owner.
OWNERS = (0.1, 0.4, 1.0)
#: No occurrence of a term contributes more than its weight times this.
CEILING = 1_000_000

POSTINGS = "n array<bigint>, terms array<int>, counts array<int>, places array<int>, tfs array<bigint>"


class Terms:
    """Numbers of known words in stretches of text."""

    def __init__(self, words: list[bytes]):
        self.table = Table(len(words) + 1)
        data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        begins = ends - [len(w) for w in words]
        made = self.table.add(np.zeros(0, np.int32), np.zeros(len(words), np.int32))
        short = ends - begins <= 16
        head, tail, n = short_keys(data, begins[short], ends[short])
        self.table.place(made[short], head, tail, n)
        self.long = {w: int(k) for w, k in zip(words, made) if len(w) > 16}

    def find(self, s: Stretch) -> np.ndarray:
        """For every word of the stretch its number, or -1."""
        length = s.end - s.begin
        out = np.zeros(len(length), np.int32)
        short = length <= 16
        data = np.concatenate([s.data, np.zeros(8, np.uint8)])
        out[short] = self.table.find(*short_keys(data, s.begin[short], s.end[short]))
        rest = np.flatnonzero(~short)
        if len(rest) and self.long:
            spans = zip(s.begin[rest].tolist(), s.end[rest].tolist())
            out[rest] = [self.long.get(s.data[a:b].tobytes(), 0) for a, b in spans]
        return out - 1


class Items(NamedTuple):
    """The items of one pass: ids, and for each the numbers and repeats of its terms."""

    ids: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    words: list[bytes]


class Plan(NamedTuple):
    """What scores depend on besides the postings."""

    items: Items
    weights: np.ndarray
    owners: np.ndarray
    documents: int
    words: int
    best: int
    bundle: int

    def members(self, bundle: int) -> range:
        return range(bundle * self.bundle, min((bundle + 1) * self.bundle, len(self.items.ids)))

    def value(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What one occurrence weighs, in millionths, for tf occurrences in a document of n terms."""
        m = 25 + (75 * n * self.documents) // max(self.words, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def words_of(texts: DataFrame, name: str, text_column: str, carry: str) -> DataFrame:
    """(carried column, terms): the distinct terms of each text with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in stretches(batch.column(1), alphanumeric(), lower=True):
                raw = s.data.tobytes()
                held = []
                for i in range(s.rows):
                    spans = zip(s.begin[s.bounds[i] : s.bounds[i + 1]].tolist(), s.end[s.bounds[i] : s.bounds[i + 1]].tolist())
                    held.append(list(Counter(raw[a:b] for a, b in spans).items()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), pa.array(held, kind)], names=schema.names
                )

    kind = pa.map_(pa.binary(), pa.int64())
    rows = texts.select(texts[carry].alias(name), texts[text_column].alias("text"))
    schema = with_fields(rows.select(name).schema, "terms map<binary, bigint>")
    return rows.mapInArrow(run, schema)


def shards(
    docs: DataFrame,
    words: list[bytes],
    id_column: str,
    text_column: str,
    documents: int = SHARD_DOCUMENTS,
    postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(shard, ids, n, terms, counts, places, tfs): postings of ``words`` in some thousand documents a row.

    ``ids`` and ``n``, the number of terms, are those of the documents with any term; the
    postings of terms[k] are the next counts[k] entries of places, which count documents of
    the shard from 0, and tfs.
    """
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(held.value)
        task, count = TaskContext.get().partitionId() << 32, 0
        ids, sizes, parts, size = [], [], [], 0
        kind = None

        def row() -> pa.RecordBatch:
            key, tfs = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key % len(held.value), kind="stable") if len(key) else key
            key, tfs = key[order], tfs[order]
            terms, counts = np.unique(key % max(len(held.value), 1), return_counts=True)
            lists = [
                pa.array([ids], pa.list_(kind)),
                *[pa.array([x], pa.list_(t)) for x, t in (
                    (np.concatenate(sizes), pa.int64()), (terms, pa.int32()), (counts, pa.int32()),
                    (key // max(len(held.value), 1), pa.int32()), (tfs, pa.int64()),
                )],
            ]
            return pa.RecordBatch.from_arrays([pa.array([task + count], pa.int64()), *lists], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for s in stretches(batch.column(1), alphanumeric(), lower=True):
                n = np.diff(s.bounds)
                own = np.flatnonzero(n)
                found = known.find(s)
                place = np.zeros(s.rows, np.int64)
                place[own] = np.arange(len(own)) + len(ids)
                hit = np.flatnonzero(found >= 0)
                key = np.repeat(place, n)[hit] * len(held.value) + found[hit]
                parts.append(np.unique(key, return_counts=True))
                ids += batch.column(0).take(pa.array(s.first + own)).to_pylist()
                sizes.append(n[own])
                size += len(parts[-1][0])
                if len(ids) >= documents or size >= postings:
                    yield row()
                    ids, sizes, parts, size = [], [], [], 0
                    count += 1
        if ids:
            yield row()

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    of = rows.schema["id"].dataType.simpleString()
    schema = with_fields(rows.limit(0).selectExpr("0L AS shard").schema, f"ids array<{of}>, {POSTINGS}")
    return rows.mapInArrow(run, schema)


def _lists(row: pa.Table, name: str) -> np.ndarray:
    return row.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def owned(rows: DataFrame, plan, owner: int, last: bool) -> DataFrame:
    """(shard, bundle, n, terms, counts, places, tfs, ids): of each shard what one owner holds for a bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        bundles = -(-len(p.items.ids) // p.bundle)
        wanted = np.zeros((bundles, len(p.weights)), bool)
        for i, terms in enumerate(p.items.terms):
            wanted[i // p.bundle, terms] = True
        wanted &= p.owners == owner
        for batch in batches:
            for k in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(k, 1)])
                terms, counts, places, tfs = (_lists(one, c) for c in ("terms", "counts", "places", "tfs"))
                of = np.repeat(terms, counts)
                for bundle in range(bundles):
                    chosen = wanted[bundle, terms]
                    post = wanted[bundle, of]
                    made = (terms[chosen], counts[chosen], places[post], tfs[post])
                    arrays = [one.column("shard").combine_chunks(), pa.array([bundle], pa.int32()), one.column("n").combine_chunks()]
                    arrays += [pa.array([x], schema_of.field(c).type) for x, c in zip(made, ("terms", "counts", "places", "tfs"))]
                    if last:
                        arrays.append(one.column("ids").combine_chunks())
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    numbers = {"terms": pa.int32(), "counts": pa.int32(), "places": pa.int32(), "tfs": pa.int64()}
    schema_of = pa.schema([(k, pa.list_(t)) for k, t in numbers.items()])
    schema = with_fields(rows.select("shard").schema, f"bundle int, {POSTINGS}")
    if last:
        schema = schema.add(rows.schema["ids"])
    return rows.mapInArrow(run, schema)


ACCUMULATED = "shard long, bundle int, filled array<int>, docs array<int>, scores array<bigint>"


def _added(plan: Plan, bundle: int, left: pa.Table, right: pa.Table) -> np.ndarray:
    """Scores (items of the bundle x documents of the shard) after this owner."""
    items = plan.members(bundle)
    n = _lists(right, "n")
    scores = np.zeros((len(items), len(n)), np.int64)
    if left.num_rows:
        scores[np.repeat(np.arange(len(items)), _lists(left, "filled")), _lists(left, "docs")] = _lists(left, "scores")
    terms, counts, places, tfs = (_lists(right, c) for c in ("terms", "counts", "places", "tfs"))
    gains = np.repeat(plan.weights[terms], counts) * plan.value(tfs, n[places])
    ends = np.cumsum(counts)
    spot = np.full(len(plan.weights), -1)
    spot[terms] = np.arange(len(terms))
    for k, item in enumerate(items):
        for at, times in zip(spot[plan.items.terms[item]].tolist(), plan.items.repeats[item].tolist()):
            if at >= 0:
                a, b = ends[at] - counts[at], ends[at]
                scores[k, places[a:b]] += times * gains[a:b]
    return scores


def _carry_on(plan: Plan, owner: int, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The accumulators of documents that may still be among the best."""
    shard, bundle = (x.as_py() for x in key)
    scores = _added(plan, bundle, left, right)
    filled, docs, kept = [], [], []
    for item, own in zip(plan.members(bundle), scores):
        terms = plan.items.terms[item]
        later = plan.owners[terms] > owner
        to_come = CEILING * int((plan.weights[terms] * plan.items.repeats[item])[later].sum())
        known = np.flatnonzero(own)
        if len(known) > plan.best:
            least = np.partition(own[known], -plan.best)[-plan.best]
            known = known[own[known] + to_come >= least]
        filled.append(len(known))
        docs.append(known)
        kept.append(own[known])
    columns = {"filled": filled, "docs": np.concatenate(docs), "scores": np.concatenate(kept)}
    kinds = {"filled": pa.int32(), "docs": pa.int32(), "scores": pa.int64()}
    lists = {c: pa.array([x], pa.list_(kinds[c])) for c, x in columns.items()}
    return pa.table({"shard": pa.array([shard], pa.int64()), "bundle": pa.array([bundle], pa.int32()), **lists})


def _best(plan: Plan, key: tuple, left: pa.Table, right: pa.Table, item_type, doc_type) -> pa.Table:
    """The best documents of the shard for each item, ties by id."""
    bundle = key[1].as_py()
    scores = _added(plan, bundle, left, right)
    ids = right.column("ids").combine_chunks().flatten().to_pylist()
    rows = []
    for item, own in zip(plan.members(bundle), scores):
        known = np.flatnonzero(own)
        if len(known) > plan.best:
            least = np.partition(own[known], -plan.best)[-plan.best]
            known = known[own[known] >= least]
        first = sorted((-int(own[d]), ids[d] is not None, ids[d]) for d in known.tolist())[: plan.best]
        rows += [(item, plan.items.ids[item], doc, -score) for score, _, doc in first]
    item, names, docs, sums = zip(*rows) if rows else ((),) * 4
    return pa.table(
        {
            "item": pa.array(item, pa.int32()),
            "item_id": pa.array(names, item_type),
            "doc_id": pa.array(docs, doc_type),
            "score": pa.array(sums, pa.int64()),
        }
    )


def _plan(rows: DataFrame, items: Items, best: int, bundle: int, shares: Sequence[float]) -> Plan:
    """Weights and owners from counts over all documents: one row per term of the items."""
    documents, words = rows.select(
        F.sum(F.size("ids").cast("long")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))
    ).first()
    documents, words = documents or 0, words or 0
    spread = rows.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df"))
    df = np.zeros(len(items.words), np.int64)
    for term, count in spread.collect():
        df[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    order = np.argsort(-weights, kind="stable")
    share = np.cumsum(df[order]) / max(int(df.sum()), 1)
    owners = np.zeros(len(df), np.int64)
    owners[order] = np.minimum(np.searchsorted(shares, share), len(shares) - 1)
    return Plan(items, weights, owners, documents, words, best, bundle)


def _search(rows: DataFrame, plan, owners: int, item_field: str) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of every shard for every item."""
    doc_type = rows.schema["ids"].dataType.elementType.simpleString()
    accumulated = rows.sparkSession.createDataFrame([], ACCUMULATED)
    for owner in range(owners - 1):
        accumulated = _met(accumulated, owned(rows, plan, owner, False)).applyInArrow(_step(plan, owner), ACCUMULATED)
    types = [_arrow(item_field), _arrow(doc_type)]
    finish = lambda key, left, right: _best(plan.value, key, left, right, *types)
    return _met(accumulated, owned(rows, plan, owners - 1, True)).applyInArrow(
        finish, f"item int, item_id {item_field}, doc_id {doc_type}, score long"
    )


def _met(accumulated: DataFrame, postings: DataFrame):
    return accumulated.groupBy("shard", "bundle").cogroup(postings.groupBy("shard", "bundle"))


def _step(plan, owner: int):
    return lambda key, left, right: _carry_on(plan.value, owner, key, left, right)


def _arrow(name: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if name not in kinds:
        raise TypeError(f"ids are integers or strings, not {name}")
    return kinds[name]


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    best: int = 10,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    pass_terms: int = PASS_TERMS,
    shard_documents: int = SHARD_DOCUMENTS,
    shard_postings: int = SHARD_POSTINGS,
    bundle: int = BUNDLE,
    owners: Sequence[float] = OWNERS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every item with a score above 0.

    Terms are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. With N the
    documents that have a term, L all their terms, n one document's and df the documents
    that hold a term, its weight is floor(1000 ln((2N + 2) / (2 df + 1))), m is
    25 + 75 n N div L, and tf occurrences score weight * (10**9 tf div (1000 tf + 8 m)).

    The documents are scanned once for each ``pass_terms`` terms of items. What moves is
    postings of the items' terms and accumulators, in shards of bounded size that no key
    decides, so neither a hot term nor a hot source gathers in one task.

    A null or empty text has no terms: such a document is not counted and never found, such
    an item has no rows. Rows that repeat an id are ranked as documents, or items, of their
    own. Equal scores go by ascending id, null first. Other columns are not read.
    """
    prepared(docs.sparkSession)
    told = stage(words_of(items, "item_id", text_column, item_column), "items")
    told = told.filter(F.size("terms") > 0)
    passes = -(-(told.agg(F.sum(F.size("terms"))).first()[0] or 0) // pass_terms)
    kind = told.schema["item_id"].dataType.simpleString()
    found = []
    for k in range(passes):
        chosen = told.filter(F.pmod(F.xxhash64("item_id", F.map_keys("terms")), F.lit(passes)) == k).collect()
        if not chosen:
            continue
        words = sorted({bytes(w) for r in chosen for w in r.terms})
        number = {w: i for i, w in enumerate(words)}
        terms = [np.array([number[bytes(w)] for w in r.terms], np.int64) for r in chosen]
        repeats = [np.array(list(r.terms.values()), np.int64) for r in chosen]
        these = Items([r.item_id for r in chosen], terms, repeats, words)
        rows = stage(shards(docs, words, id_column, text_column, shard_documents, shard_postings), "shards")
        plan = docs.sparkSession.sparkContext.broadcast(_plan(rows, these, best, bundle, owners))
        some = _search(rows, plan, len(owners), kind)
        found.append(some.withColumn("part", F.lit(k)))
    if not found:
        kinds = docs.select(docs[id_column].alias("doc_id")).schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {kinds}, score long")
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
