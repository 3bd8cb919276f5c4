"""Best-fit packing: whole documents in as few sequences as possible, by minimum bin slack.

One sequence is filled at a time. It starts with the longest piece that is left; which sums
of other lengths fit beside it is held in the bits of one integer, to which each length
adds itself by shifts, and the fullest sum is read off and its pieces are taken out.

The work is dealt out twice. Every task of the scan fills sequences from its own pieces and
keeps those without any slack; what is left, a few hundredths of the tokens, moves once and
is filled up to the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stage, with_fields
from .text import portions
from .tokens import encoder, id_lists

SIZE = 4096
#: Tokens that a task fills into sequences at once; they are held in memory.
BLOCK = 4 << 20
#: Sequence ids: round above, then the task, then a count within the task.
ROUND, TASK = 60, 28

PIECE = "piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """A choice of lengths with the largest sum up to ``room``.

    ``lengths`` fall; each can be taken ``counts`` times. Bit t of ``sums`` says that some
    choice comes to t. Shifts by 1, 2, 4, ... copies and the rest allow for every number of
    copies. Longer pieces are tried first and the search ends when ``room`` itself is
    reached, so short pieces are saved for later.
    """
    sums, within = 1, (1 << (room + 1)) - 1
    steps = []
    for length in lengths:
        if length > room:
            continue
        steps.append((length, sums))
        copies, step = min(counts[length], room // length), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << step * length) & within
            copies -= step
            step *= 2
        if sums >> room:
            break
    target, chosen = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        while not before >> target & 1:
            target -= length
            chosen.append(length)
    return chosen


class Shelf:
    """Pieces by length, and the sequences filled from them."""

    def __init__(self, size: int):
        self.size = size
        self.by_length: dict[int, list[int]] = {}
        self.held = 0

    def add(self, number: int, length: int) -> None:
        self.by_length.setdefault(length, []).append(number)
        self.held += length

    def fill(self, slack: int) -> tuple[list[list[int]], list[int]]:
        """Numbers of the pieces in each sequence with at most ``slack`` to spare, and those left over.

        A sequence with more to spare is left over as a whole: its longest piece keeps what
        fits it best from being taken by shorter ones.
        """
        pieces = self.by_length
        counts = {length: len(own) for length, own in pieces.items()}
        lengths = sorted(counts, reverse=True)
        sequences, left = [], []
        while lengths:
            seed = lengths[0]
            counts[seed] -= 1
            if not counts[seed]:
                lengths.pop(0)
            rest = fullest(self.size - seed, lengths, counts)
            for length in rest:
                counts[length] -= 1
                if not counts[length]:
                    lengths.remove(length)
            taken = [pieces[length].pop() for length in (seed, *rest)]
            if self.size - seed - sum(rest) > slack:
                left += taken
            else:
                sequences.append(taken)
        self.by_length, self.held = {}, 0
        return sequences, left


class Writer:
    """Rows of filled sequences as record batches of some million ids."""

    def __init__(self, schema, kind: pa.DataType, base: int):
        self.schema, self.kind, self.base, self.count = schema, kind, base, 0

    def batches(self, sequences: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        """Sequences of pieces (doc, piece, start, ids, tokens of the document)."""
        rows, held = [], 0
        for pieces in sequences:
            offset = 0
            for doc, piece, start, ids, total in pieces:
                rows.append((doc, piece, start, ids, total, self.base + self.count, offset))
                offset += len(ids)
            self.count += 1
            held += offset
            if held >= 1 << 20:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def left(self, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Pieces without a sequence; a number below zero tells them apart."""
        if pieces:
            first = -1 - self.base - self.count
            yield self.batch([(*p, first - k, 0) for k, p in enumerate(pieces)])
            self.count += len(pieces)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        docs, pieces, starts, ids, totals, sequences, offsets = zip(*rows)
        counts = np.array([len(x) for x in ids], np.int64)
        sums = [zlib.crc32(np.ascontiguousarray(x).view(np.uint8)) for x in ids]
        arrays = [pa.array(docs, self.kind), pa.array(pieces, pa.int32())]
        arrays += [pa.array(x, pa.int64()) for x in (starts, counts, sums, totals, sequences, offsets)]
        return pa.RecordBatch.from_arrays([*arrays, id_lists(np.concatenate(ids), counts)], names=self.schema.names)


def pack_full(
    docs: DataFrame,
    vocabulary: str,
    end: int = 1,
    size: int = SIZE,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each text is encoded, followed by ``end``, and cut only if longer than ``size``, into
    pieces of ``size`` and a rest. No text moves between tasks: a task of the scan takes
    ``block`` tokens at a time and keeps the sequences that come out full. Pieces that
    found no full sequence are dealt out by a hash of their own number, so that copies and
    hot documents spread, in groups of about ``block`` tokens; each group fills sequences
    with the least slack until nothing is left, so at most one sequence a group is filled
    poorly for want of pieces. Both rounds are written to the shared folder.

    A null or empty text is one piece with the end id alone. Rows that repeat an id are
    separate documents, null ids are passed on, other columns are not read. An empty table
    gives no pieces. Ties are settled by length alone, so which of several equally long
    pieces goes where is not defined.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    schema = with_fields(rows.select("doc_id").schema, PIECE)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        writer, shelf, left = None, Shelf(size), []
        pieces: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sequences, rest = shelf.fill(0)
            yield from writer.batches([[pieces[k] for k in s] for s in sequences])
            left.extend(pieces[k] for k in rest)
            pieces.clear()

        for batch in batches:
            writer = writer or Writer(schema, batch.column(0).type, TaskContext.get().partitionId() << TASK)
            for first, data, edges in portions(batch.column(1)):
                ids, counts = encode.closed(data, edges, end)
                whole, at = [], 0
                for doc, total in zip(batch.column(0)[first : first + len(counts)].to_pylist(), counts.tolist()):
                    for piece, start in enumerate(range(0, total, size)):
                        own = ids[at + start : at + min(start + size, total)]
                        made = (doc, piece, start, own, total)
                        if len(own) == size:
                            whole.append([made])
                        else:
                            shelf.add(len(pieces), len(own))
                            pieces.append(made)
                    at += total
                yield from writer.batches(whole)
                if shelf.held >= block:
                    yield from flush()
                    if sum(len(p[3]) for p in left) >= block:
                        yield from writer.left(left)
                        left.clear()
        if writer:
            yield from flush()
            yield from writer.left(left)

    def finish(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bucket = group.column("bucket")[0].as_py()
        writer = Writer(schema, group.column(0).type, (1 << ROUND) + (bucket << TASK))
        docs, number, start, total = (group.column(c).to_pylist() for c in ("doc_id", "piece", "start", "doc_tokens"))
        shelf, pieces = Shelf(size), []
        for k, ids in enumerate(_lists(group.column("ids"))):
            pieces.append((docs[k], number[k], start[k], ids, total[k]))
            shelf.add(k, len(ids))
        sequences, _ = shelf.fill(size)
        return pa.Table.from_batches(writer.batches([[pieces[k] for k in s] for s in sequences]))

    filled = stage(rows.mapInArrow(fill, schema), "filled")
    left = filled.filter("sequence_id < 0")
    tokens = left.agg(F.sum("length")).first()[0]
    if not tokens:
        return filled
    buckets = -(-tokens // block)
    dealt = left.withColumn("bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(buckets)))
    rest = stage(dealt.groupBy("bucket").applyInArrow(finish, schema), "rest")
    return filled.filter("sequence_id >= 0").unionByName(rest)


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The lists of a column as numpy slices, without Python integers."""
    for chunk in column.chunks:
        edges, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        for a, b in zip(edges[:-1], edges[1:]):
            yield values[a:b]
