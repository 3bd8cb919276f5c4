"""Near-duplicate documents: min-max hashing, banding, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage, with_fields
from .components import components
from .text import U, mix, spaced, stretches, window_hashes, word_hashes

#: Permutations. Each gives two values, its minimum and its maximum, so 96 values.
PERMUTATIONS = 48
#: Two minima and two maxima a band: a pair at similarity 0.8 misses all 24 bands with
#: probability 3e-6, one at 0.3 meets in any with probability 0.18.
BANDS = 24
#: Documents, named by id, up to which a list of ids is broadcast to the scan of the texts.
ID_LIMIT = 2_000_000
#: Rounds in which the members of a bucket are compared with one document of it.
HUB_ROUNDS = 2
#: Shingles, about, in a block of documents that are compared with another block.
BLOCK = 1 << 16


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; a shorter text is one shingle."""
    if len(words) >= size:
        return np.unique(window_hashes(words, size))
    return window_hashes(words, len(words), salt=len(words)) if len(words) else np.zeros(0, U)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(1729)
    odd = draw.integers(0, 2**63, PERMUTATIONS, np.int64).astype(U) * U(2) + U(1)
    return odd[:, None], draw.integers(0, 2**63, PERMUTATIONS, np.int64).astype(U)[:, None]


def min_max(shingles: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the set under every permutation."""
    low = np.full(PERMUTATIONS, U(2**64 - 1), U)
    high = np.zeros(PERMUTATIONS, U)
    for at in range(0, len(shingles), 2048):
        values = odd * shingles[at : at + 2048] + shift
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Band j joins minima and maxima of different permutations, as those of one depend on each other in small sets."""
    per = PERMUTATIONS // BANDS
    lows = low.reshape(BANDS, per)
    highs = np.roll(high.reshape(BANDS, per), BANDS // 2, axis=0)
    h = np.arange(1, BANDS + 1, dtype=U)
    for column in np.concatenate([lows, highs], axis=1).T:
        h = mix(h * U(0x9E3779B97F4A7C15) + column)
    return h


def signatures(docs: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n_shingles, d1, d2, bands): set size, digest of the set, and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, shift = _permutations()
        for batch in batches:
            counts, first, second, keys = [], [], [], []
            for s in stretches(batch.column(1), spaced(), lower=True):
                words = word_hashes(s)
                for i in range(s.rows):
                    x = shingle_set(words[s.bounds[i] : s.bounds[i + 1]], size)
                    counts.append(len(x))
                    first.append(int(np.sum(mix(x ^ U(0x1234567)), dtype=U).view(np.int64)))
                    second.append(int(np.sum(mix(x ^ U(0x89ABCDEF)), dtype=U).view(np.int64)))
                    keys.append(band_keys(*min_max(x, odd, shift)).view(np.int64) if len(x) else np.zeros(0, np.int64))
            edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            made = [pa.array(x, pa.int64()) for x in (counts, first, second)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, bands], names=names)

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = with_fields(rows.select("id").schema, "n_shingles long, d1 long, d2 long, bands array<bigint>")
    names = schema.names
    return rows.mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(id, shingles) of the documents in ``ids``."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for s in stretches(batch.column(1), spaced(), lower=True):
                words = word_hashes(s)
                sets += [
                    shingle_set(words[s.bounds[i] : s.bounds[i + 1]], size).view(np.int64) for i in range(s.rows)
                ]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(edges, flat)], names=["id", "shingles"]
            )

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    wanted = ids.select("id").distinct()
    if wanted.count() <= ID_LIMIT:
        wanted = F.broadcast(wanted)
    chosen = rows.join(wanted, "id", "left_semi")
    return chosen.mapInArrow(collect, with_fields(rows.select("id").schema, "shingles array<bigint>"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: groups of near copies.

    1. One scan takes the set of ``size``-word shingles of each text and from it the
       min-max signature, 24 band keys and a digest of the set.
    2. Documents with equal sets become one class, named by its smallest id. Only these
       go on, so thousands of exact copies cost one row.
    3. Classes that share a band key form a bucket. Its hub is the member that shares
       buckets with most others. Each member is paired with the hub, not with all others,
       and the pair is confirmed on the full sets.
    4. Members that a hub did not link may still be linked to each other. Buckets whose
       members lie in different components get another hub; then what is still outside a
       cluster's largest component is compared with the whole cluster, in blocks, so no
       link is lost. Documents with too many shingles of their own are excused first.

    A text without words has an empty set and is linked with nothing. Null ids are not
    linked and get a null component; they are kept. Rows that repeat an id share its
    component. Other columns are not read.
    """
    known = stage(signatures(docs, size, id_column, text_column), "signatures")
    classes = stage(
        known.filter("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("d1", "d2", "n_shingles")
        .agg(F.min("id").alias("class")),
        "classes",
    )
    firsts = classes.select(F.col("class").alias("id")).distinct()
    buckets = known.join(firsts, "id").select("id", "n_shingles", F.explode("bands").alias("key")).distinct()
    busy = buckets.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = stage(buckets.join(busy, "key"), "members")
    weights = members.groupBy("id").agg(F.sum("members").alias("weight"))
    members = stage(members.join(weights, "id").select("key", "id", "n_shingles", "weight"), "members")
    links = _links(docs, members, size, percent, id_column, text_column)
    # Ids with several sets tie the classes of these together. Most tables have none.
    sets = F.struct("d1", "d2", "n_shingles")
    several = known.filter("id IS NOT NULL").groupBy("id").agg(F.min(sets).alias("low"), F.max(sets).alias("high"))
    several = stage(several.filter("low <> high").select("id"), "several")
    repeated = not several.isEmpty()
    if repeated:
        owned = known.join(several, "id", "left_semi").join(classes, ["d1", "d2", "n_shingles"])
        links = stage(links.unionByName(owned.select(F.col("id").alias("a"), F.col("class").alias("b"))), "links")
    roots = components(links)

    per_class = classes.join(roots, classes["class"] == roots["node"], "left").select(
        "d1", "d2", "n_shingles", F.coalesce("root", "class").alias("component_id")
    )
    labelled = known.drop("bands").join(per_class, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    if repeated:
        # rows without a set share the component of their id as well
        labelled = stage(labelled.withColumn("component_id", component), "labelled")
        of_id = labelled.join(several, "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("_of_id"))
        labelled = labelled.join(of_id, "id", "left").withColumn("component_id", F.coalesce("_of_id", "component_id"))
    return labelled.select(
        F.col("id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(docs, members, size, percent, id_column, text_column) -> DataFrame:
    sets = stage(shingle_sets(docs, members, size, id_column, text_column), "sets")
    links = None
    placed = members.withColumn("root", F.col("id"))
    similar = 100 * F.least("n_shingles", "hub_shingles") >= percent * F.greatest("n_shingles", "hub_shingles")
    for step in range(HUB_ROUNDS):
        # the heaviest member that was not compared with this bucket before
        fresh = placed if step == 0 else placed.join(used, ["key", "id"], "left_anti")
        hubs = fresh.groupBy("key").agg(F.max(F.struct("weight", "id", "n_shingles", "root")).alias("hub"))
        hubs = stage(
            hubs.select(
                "key",
                F.col("hub.id").alias("hub"),
                F.col("hub.n_shingles").alias("hub_shingles"),
                F.col("hub.root").alias("hub_root"),
            ),
            "hubs",
        )
        used = hubs.select("key", F.col("hub").alias("id"))
        pairs = (
            placed.join(hubs, "key")
            .filter(similar & (F.col("root") != F.col("hub_root")))
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
            .distinct()
        )
        found = confirmed(stage(pairs, "pairs"), sets, percent)
        links = stage(found if links is None else links.union(found), "links")
        roots = components(links).withColumnRenamed("node", "id")
        placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # only buckets that still hold several components go on
        split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        placed = stage(placed.join(split.select("key"), "key", "left_semi"), "placed")
        if placed.isEmpty():
            return links
    return stage(links.union(_across_components(placed, sets, percent)), "links")


def _across_components(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between documents of one cluster that lie in different components.

    A cluster is what buckets tie together. Shingles that only one document has cannot be
    shared: a document of n shingles with u such ones overlaps others in n - u at most, and
    is out if that is below the similarity even against an equal set. Of the others, those
    outside the cluster's largest component are compared with all, block by block.
    """
    first = placed.groupBy("key").agg(F.min("id").alias("b"))
    clusters = components(placed.join(first, "key").select(F.col("id").alias("a"), "b")).select(
        F.col("node").alias("id"), F.col("root").alias("cluster")
    )
    ones = placed.select("id", "n_shingles", "root").distinct().join(clusters, "id")
    here = sets.join(ones.select("id"), "id", "left_semi")
    own = (
        here.select("id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.min("id").alias("id"))
        .filter("holders = 1")
        .groupBy("id")
        .agg(F.count("*").alias("own"))
    )
    able = ones.join(own, "id", "left").filter(
        100 * (F.col("n_shingles") - F.coalesce("own", F.lit(0))) >= percent * F.col("n_shingles")
    )
    able = stage(able.drop("own"), "able")
    per_root = able.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    largest = per_root.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    blocks = able.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("blocks"))
    dealt = (
        able.join(largest.filter("roots > 1"), "cluster")
        .join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("asks", F.col("root") != F.col("top.root"))
        .join(sets, "id")
    )
    one = F.struct("id", "root", "shingles")
    answers = stage(dealt.groupBy("cluster", "block").agg(F.collect_list(one).alias("answers")), "answers")
    asking = dealt.filter("asks").groupBy("cluster", F.col("block").alias("other")).agg(F.collect_list(one).alias("asking"))
    asking = stage(asking, "asking")
    pairs = asking.select("cluster", "other").join(answers.select("cluster", "block"), "cluster")
    both = pairs.join(asking, ["cluster", "other"]).join(answers, ["cluster", "block"]).select("asking", "answers")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = _linked(*(batch.column(c)[k].values for c in (0, 1)), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type.value_type.field(0).type), pa.array(b, batch.column(0).type.value_type.field(0).type)], names=["a", "b"])

    kind = sets.schema["id"].dataType.simpleString()
    return both.mapInArrow(compare, f"a {kind}, b {kind}")


def _linked(asking: pa.StructArray, answers: pa.StructArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between two blocks that reach the similarity and lie in different components."""
    ids, roots = (np.asarray(asking.field(k)) for k in (0, 1))
    lists = asking.field(2)
    edges = np.asarray(lists.offsets)
    sizes = np.diff(edges)
    flat = np.asarray(lists.values)[edges[0] : edges[-1]]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(ids)), sizes)[order]
    low, high = [ids[:0]], [ids[:0]]
    other_ids, other_roots, other = np.asarray(answers.field(0)), np.asarray(answers.field(1)), answers.field(2)
    other_edges, values = np.asarray(other.offsets), np.asarray(other.values)
    for k in range(len(other_ids)):
        x = values[other_edges[k] : other_edges[k + 1]]
        start = np.searchsorted(flat, x, "left")
        n = np.searchsorted(flat, x, "right") - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(ids))
        hit = (100 * both >= percent * (sizes + len(x) - both)) & (roots != other_roots[k])
        low.append(np.minimum(ids[hit], other_ids[k]))
        high.append(np.maximum(ids[hit], other_ids[k]))
    return np.concatenate(low), np.concatenate(high)
