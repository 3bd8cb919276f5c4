"""Benchmark decontamination: a broadcast hash set of test n-grams against every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import no_clash, stage, with_fields
from .text import U, alphanumeric, stretches, window_hashes, word_hashes

WINDOW = 10
#: Item windows held by a task at once (about 200 bytes each). More are taken in blocks.
BLOCK = 500_000
_FILTER_BITS = 22


def item_windows(benchmark: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(item, n, gram): the windows of each item; one of n < size words if it is shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, grams = [], [], []
            names = batch.column(0).to_pylist()
            for s in stretches(batch.column(1), alphanumeric(), lower=True):
                for i in range(s.rows):
                    lo, hi = s.bounds[i], s.bounds[i + 1]
                    words = [s.data[a:b].tobytes() for a, b in zip(s.begin[lo:hi], s.end[lo:hi])]
                    n = min(size, len(words))
                    for k in range(len(words) - n + 1 if n else 0):
                        items.append(names[s.first + i])
                        sizes.append(n)
                        grams.append(b" ".join(words[k : k + n]).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string())],
                names=["item", "n", "gram"],
            )

    rows = benchmark.select(benchmark[id_column].cast("string").alias("item"), benchmark[text_column].alias("text"))
    return rows.mapInArrow(cut, "item string, n int, gram string").distinct()


class GramSet:
    """Windows of items by length: a bit filter, sorted hashes, and the words to verify with."""

    def __init__(self, rows: list[tuple[int, str, list[str]]]):
        self.items = {(n, gram.encode()): tuple(items) for n, gram, items in rows}
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {n for n, _, _ in rows}:
            grams = pa.array([g for m, g, _ in rows if m == n], pa.string())
            found = [np.zeros(0, U)]
            for s in stretches(grams, alphanumeric()):
                found.append(window_hashes(word_hashes(s), n)[s.bounds[:-1]])
            hashes = np.unique(np.concatenate(found))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(hashes >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_size[n] = (hashes, bits)

    def hits(self, s, words: np.ndarray) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """(row, first word, n, items) of every window of the stretch that is in the set."""
        for n, (hashes, bits) in self.by_size.items():
            h = window_hashes(words, n)
            at = np.flatnonzero(bits[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
            at = at[hashes[np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)] == h[at]]
            rows = np.searchsorted(s.bounds, at, "right") - 1
            for k, row in zip(at.tolist(), rows.tolist()):
                if k + n > s.bounds[row + 1]:
                    continue  # would run into the next text
                gram = b" ".join(s.data[a:b].tobytes() for a, b in zip(s.begin[k : k + n], s.end[k : k + n]))
                items = self.items.get((n, gram))
                if items is not None:
                    yield row, k - int(s.bounds[row]), n, items


def _scan(docs: DataFrame, grams: list, carry: list[str], text_column: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(grams)
    fields = docs.select(*carry).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = GramSet(held.value)
        for batch in batches:
            texts = batch.column(len(carry))
            n_words, all_hits, all_items = [], [], []
            for s in stretches(texts, alphanumeric(), lower=True):
                hits: dict[int, set[int]] = {}
                items: dict[int, set[str]] = {}
                for row, k, n, names in known.hits(s, word_hashes(s)):
                    hits.setdefault(row, set()).update(range(k, k + n))
                    items.setdefault(row, set()).update(x for x in names if x is not None)
                n_words += np.diff(s.bounds).tolist()
                all_hits += [sorted(hits.get(i, ())) for i in range(s.rows)]
                all_items += [sorted(items.get(i, ()), key=str.encode) for i in range(s.rows)]
            made = [
                pa.array(n_words, pa.int64()),
                pa.array(all_hits, pa.list_(pa.int32())),
                pa.array(all_items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carry))] + made, names=[*carry, "n_words", "hits", "items"]
            )

    schema = with_fields(fields, "n_words long, hits array<int>, items array<string>")
    return docs.select(*carry, docs[text_column].alias("__text")).mapInArrow(find, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """For each row its words, the positions of hit words, and the items found there.

    Words are ``[0-9a-z]`` and everything beyond ASCII, after A-Z were lower-cased. The
    item windows are counted first. Up to ``block`` of them are broadcast and the texts
    are scanned once, without a shuffle. More are taken in blocks by hash, one scan each,
    and the hits, which are few, are merged by id and text digest.

    A null text has no words. An item with a null id hits, but is not listed; an item
    without words is ignored; repeated items count once. Repeated rows are judged each by
    itself. An empty benchmark hits nothing. Only the named and ``carry`` columns are read.
    """
    no_clash(carry, [id_column, "n_words", "hits", "items"])
    columns = [id_column, *carry]
    grams = item_windows(benchmark, size, item_column, item_text_column)
    total = grams.count()
    if total <= block:
        rows = grams.groupBy("n", "gram").agg(F.collect_set("item").alias("items")).collect()
        return _scan(docs, [(r.n, r.gram, r["items"]) for r in rows], columns, text_column)

    grams = stage(grams, "grams")
    blocks = -(-total // block)
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce(text_column, F.lit("")), 256))
    found = None
    for k in range(blocks):
        part = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k)
        rows = part.groupBy("n", "gram").agg(F.collect_set("item").alias("items")).collect()
        one = _scan(keyed, [(r.n, r.gram, r["items"]) for r in rows], [id_column, "__digest"], text_column)
        one = stage(one.filter(F.size("hits") > 0).drop("n_words"), "hits")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy(id_column, "__digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    base = _scan(keyed, [], [*columns, "__digest"], text_column).drop("hits", "items").alias("base")
    merged = merged.alias("merged")
    same = F.col(f"base.{id_column}").eqNullSafe(F.col(f"merged.{id_column}")) & (
        F.col("base.__digest") == F.col("merged.__digest")
    )
    return base.join(merged, same, "left").select(
        *[F.col(f"base.{c}") for c in columns],
        "n_words",
        F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination_report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items, from the columns of ``find_contamination``."""
    return found.select(
        id_column,
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_spans(found: DataFrame, text_column: str = "text", most: float = 0.5) -> DataFrame:
    """Cut hit words, with what separates them, out of the texts.

    ``found`` comes from ``find_contamination`` with the text among its carried columns.
    Documents of whose words more than the share ``most`` is hit are dropped whole; other
    texts keep all bytes outside the hit runs.
    """
    fields = found.schema
    at = found.columns.index(text_column)
    hits_at = found.columns.index("hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(hits_at).to_pylist()
            texts = batch.column(at).to_pylist()
            for s in stretches(batch.column(at), alphanumeric(), lower=True):
                for i in range(s.rows):
                    gone = hits[s.first + i]
                    if not gone:
                        continue
                    text = texts[s.first + i].encode()
                    lo, a = int(s.bounds[i]), int(s.edges[i])
                    stop = int(s.bounds[i + 1])
                    pieces, kept_to = [], 0
                    for k, word in enumerate(gone):
                        if k == 0 or word != gone[k - 1] + 1:
                            pieces.append(text[kept_to : int(s.begin[lo + word]) - a])
                        following = lo + word + 1
                        kept_to = int(s.begin[following]) - a if following < stop else len(text)
                    pieces.append(text[kept_to:])
                    texts[s.first + i] = b"".join(pieces).decode()
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    few = found.filter(F.size("hits") <= F.lit(most) * F.col("n_words"))
    return few.mapInArrow(cut, fields)
