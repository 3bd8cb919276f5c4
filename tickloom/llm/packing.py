"""Packing documents into fixed windows: order-preserving dynamic programming.

Documents follow each other by id as one stream of tokens. Windows are cut from the
stream in order; a cut at the end of a document is free, at the end of a sentence cheap,
elsewhere dear. With positions p of the possible cuts, the least cost up to cut j is

    f(j) = penalty(j) + per_window + min over i of f(i) + padding(p(j) - p(i))

for windows of at most ``size`` tokens. Padding is ``size`` minus the length, so the
minimum of f(i) + p(i) over a sliding range is wanted: a monotone queue gives it in
constant time a step. Windows whose length is a power of two need no padding and are
tried beside it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import with_fields
from .text import portions
from .tokens import encoder, id_lists, sentence_ends

SIZE = 4096
SENTENCE, ELSEWHERE, PER_WINDOW = 1.0, 64.0, 16.0
#: Cuts elsewhere are possible every so many tokens where a sentence is longer than that.
SPACING = 256
#: Tokens taken into the dynamic program at once.
BLOCK = 1 << 20


def cuts_of(places: np.ndarray, penalty: np.ndarray, size: int, per_window: float) -> list[int]:
    """Indices of the chosen cuts; ``places`` rise from 0 and no gap is above ``size``."""
    n = len(places)
    p, cost = places.tolist(), (penalty + per_window).tolist()
    exact: dict[int, list[int]] = {}
    step = 1
    while step < size:
        at = np.searchsorted(places, places - step)
        for j in np.flatnonzero(places[np.minimum(at, n - 1)] == places - step).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        step *= 2
    f, back = [0.0] * n, [0] * n
    queue = deque([(0.0, 0)])
    for j in range(1, n):
        here = p[j]
        while p[queue[0][1]] < here - size:
            queue.popleft()
        best, of = queue[0]
        best += size - here
        for i in exact.get(j, ()):
            if f[i] < best:
                best, of = f[i], i
        f[j] = best + cost[j]
        back[j] = of
        key = f[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chosen, j = [], n - 1
    while j:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def possible_cuts(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a window may end, and their penalties. 0 and the end are included."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[1:][closing[ids]] = SENTENCE
    penalty[ends] = 0.0
    penalty[[0, n]] = 0.0
    known = np.flatnonzero(penalty < np.inf)
    gaps = np.diff(known)
    for k in np.flatnonzero(gaps > SPACING).tolist():
        extra = np.arange(known[k] + SPACING, known[k + 1], SPACING)
        penalty[extra] = ELSEWHERE
    places = np.flatnonzero(penalty < np.inf)
    return places, penalty[places]


class Packer:
    """Takes documents in order and gives the pieces of finished windows."""

    def __init__(self, closing: np.ndarray, size: int, slice_number: int):
        self.closing, self.size, self.sequence = closing, size, slice_number << 32
        self.docs: list[list] = []  # id, tokens already placed, the other ids, tokens in all
        self.held = 0

    def add(self, name, ids: np.ndarray) -> None:
        self.docs.append([name, 0, ids, len(ids)])
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces (id, start, ids, tokens in all, sequence, offset)."""
        if not self.held:
            return []
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        places, penalty = possible_cuts(ids, ends, self.closing)
        chosen = places[cuts_of(places, penalty, self.size, PER_WINDOW)]
        if not last:
            chosen = chosen[:-1]  # the last window may yet be filled
        out, begin, k = [], 0, 0
        for cut in chosen.tolist():
            offset = 0
            while begin + offset < cut:
                name, placed, rest, total = doc = self.docs[k]
                n = min(len(rest), cut - begin - offset)
                out.append((name, placed, rest[:n], total, self.sequence, offset))
                doc[1], doc[2] = placed + n, rest[n:]
                offset += n
                k += n == len(rest)
            begin = cut
            self.sequence += 1
        self.docs = self.docs[k:]
        self.held = int(len(ids) - begin)
        return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    end: int = 2,
    size: int = SIZE,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids.

    Texts are dealt out by ranges of the id and sorted, and every task packs its range, so
    at most one window a task is poorly filled. A task holds ``block`` tokens at a time; the
    last window of a block is packed again with the next. ``sequence_id`` joins the task's
    number and a count within it.

    A null or empty text is one piece with the end id alone. Null ids come first and are
    passed on; rows that repeat an id are separate documents in the order of their texts;
    other columns are not read. An empty table gives no pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = Packer(sentence_ends(vocabulary), size, TaskContext.get().partitionId())
        for batch in batches:
            names = batch.column(0)
            for first, data, edges in portions(batch.column(1)):
                ids, counts = encode.closed(data, edges, end)
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for name, a, b in zip(names[first : first + len(counts)].to_pylist(), at, at[1:]):
                    packer.add(name, ids[a:b])
                if packer.held >= block:
                    yield rows(packer.flush(False))
        yield rows(packer.flush(True))

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        names, starts, ids, totals, sequences, offsets = zip(*pieces) if pieces else [()] * 6
        sums = [zlib.crc32(x.view(np.uint8)) for x in ids]
        counts = np.array([len(x) for x in ids], np.int64)
        made = [starts, counts, sums, totals, sequences, offsets]
        arrays = [pa.array(names, kind), *[pa.array(x, pa.int64()) for x in made]]
        if with_ids:
            arrays.append(id_lists(np.concatenate([np.zeros(0, np.int32), *ids]), counts))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    kind = pa.int64()
    schema = with_fields(
        texts.select("doc_id").schema,
        "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids array<int>" * with_ids,
    )
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, schema)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` taken from the ids as read, in place of the ids."""
    rest = packed.drop("ids", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            edges = lists.offsets.to_pylist()
            values = memoryview(lists.values.to_numpy()).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    schema = with_fields(rest.schema, "ids_crc32 long")
    return packed.select(*rest.columns, "ids").mapInArrow(run, schema)
