"""Substring dedup: repeated runs of words found on a compacted de Bruijn graph.

A window of ``size`` words is an edge between its first and its last ``size - 1`` words.
Edges are compacted where they are found: of the short runs (anchors) inside a window the
one with the smallest hash stands for it, and successive windows with the same anchor
form one path. Equal stretches of text choose equal anchors, so

1. anchors are counted, and only those of two or more documents go on;
2. paths over such anchors are joined by anchor and content: each occurrence but those in
   the first document is repeated from end to end;
3. an anchor with one content does not branch and is done with. Where an anchor has several
   contents, paths branch: they share some of their edges, as at the margins of a repeated
   stretch. Only there one occurrence of each content is taken apart into edges, which are
   joined in the same way;
4. what repeats is merged into spans and cut.

A match counts only if a second digest, taken from the words at the source coordinates,
agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import no_clash, stage, with_fields
from .text import U, Stretch, covered, spaced, stretches, window_hashes, word_hashes, _power_tables, mix

WINDOW = 13
ANCHOR = 5
#: Anchors of fewer bytes a word are taken only where a window has no others: runs of short
#: words repeat by chance.
LETTERS = 4.4
#: Bits of the broadcast filter of repeated anchors: 16 per anchor, this many at most
#: (32 MB). A fuller filter lets more paths through; the joins after it are exact.
MOST_BITS = 1 << 28
#: Spans, and documents with spans, that may be broadcast to a scan of the texts (at most
#: some 50 MB); more are joined by shuffle.
BROADCAST_SPANS, BROADCAST_DOCUMENTS = 2_000_000, 300_000
_ROWS = 1 << 18


def smallest(order: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each run of ``width`` values."""
    at = np.arange(len(order))
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at = np.where(order[b] < order[a], b, a)
        size += step
    return at


def anchors(s: Stretch, words: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the stretch's windows, their rows, and their anchors' hashes and places."""
    n = len(words) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros((2, 0), U),)
    short = window_hashes(words, anchor, salt=3)
    letters = np.concatenate([[0], np.cumsum(s.end - s.begin)])
    plain = letters[anchor:] - letters[:-anchor] < LETTERS * anchor
    place = smallest((short >> U(1)) | (plain.astype(U) << U(63)), size - anchor + 1)
    row = np.repeat(np.arange(s.rows), np.diff(s.bounds))[:n]
    first = np.flatnonzero(np.arange(size, n + size) <= s.bounds[1:][row])
    place = place[first]
    return first, row[first], np.stack([short[place], place.astype(U)])


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = U(len(bits) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for at in (hashes & mask, (hashes >> U(32)) & mask):
        found &= (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == U(1)
    return found


def _repeated_anchors(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            count = 0
            for s in stretches(batch.column(1), spaced()):
                first, row, found = anchors(s, word_hashes(s), size, anchor)
                new = np.ones(len(first), bool)
                new[1:] = (found[1][1:] != found[1][:-1]) | (row[1:] != row[:-1])
                held.append((found[0][new], ids[s.first + row[new]]))
                count += len(held[-1][0])
                if count >= 4 * _ROWS:
                    yield from combine(held)
                    held, count = [], 0
            yield from combine(held)

    def combine(held) -> Iterator[pa.RecordBatch]:
        """One row per anchor, however many texts of the batch hold it."""
        if not held:
            return
        hashes, owners = (np.concatenate(x) for x in zip(*held))
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        columns = (hashes[at].view(np.int64), np.minimum.reduceat(owners, at), np.maximum.reduceat(owners, at))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "low", "high"])

    rows = docs.mapInArrow(find, "anchor long, low long, high long")
    both = rows.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return both.filter("low < high").select("anchor")


def _filter_of(repeated: DataFrame) -> np.ndarray:
    """Bits of the repeated anchors: a lossy sketch of bounded size, put together by Spark."""
    bits = 1 << 16
    while bits < min(MOST_BITS, 16 * repeated.count()):
        bits *= 2
    mask = bits - 1
    words = (
        repeated.select(F.explode(F.array(F.expr(f"anchor & {mask}L"), F.expr(f"shiftrightunsigned(anchor, 32) & {mask}L"))).alias("at"))
        .groupBy(F.expr("shiftright(at, 6)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros(bits // 64, U)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(U)
    return out


def _paths(docs: DataFrame, bits: np.ndarray, size: int, anchor: int) -> DataFrame:
    """(anchor, key, check, id, tag, pos, n): paths of n edges over anchors that seem repeated."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    kinds = (pa.int64(),) * 5 + (pa.int32(),) * 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for s in stretches(batch.column(1), spaced()):
                words = word_hashes(s)
                first, row, found = anchors(s, words, size, anchor)
                if not len(first):
                    continue
                new = np.ones(len(first), bool)
                new[1:] = (found[1][1:] != found[1][:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(first)))
                chosen = passes(held.value, found[0][start])
                start, n = start[chosen], n[chosen]
                a, row = first[start], row[start]
                keys = [runs(window_hashes(words, size, salt), a, n).view(np.int64) for salt in (1, 2)]
                columns = (found[0][start].view(np.int64), *keys, ids[s.first + row], tags[s.first + row], a - s.bounds[row], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["anchor", "key", "check", "id", "tag", "pos", "n"],
                )

    return docs.mapInArrow(find, "anchor long, key long, check long, id long, tag long, pos int, n int")


def runs(hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of ``n`` successive hashes."""
    power, inverse = _power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[start + n] - sums[start]) * inverse[start] + n.astype(U))


def _edges(docs: DataFrame, coordinates: DataFrame, size: int) -> DataFrame:
    """(key, check, id, tag, pos): the edges of the paths at the coordinates."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            spans = Spans(batch)
            for s in stretches(batch.column(2), spaced()):
                words = word_hashes(s)
                at, row = [], []
                for i in range(s.rows):
                    for pos, n in spans[s.first + i]:
                        if pos + n + size - 1 <= s.bounds[i + 1] - s.bounds[i]:
                            at.append(np.arange(pos, pos + n) + s.bounds[i])
                            row.append(np.full(n, i))
                if not at:
                    continue
                at, row = np.concatenate(at), np.concatenate(row)
                keys = [window_hashes(words, size, salt)[at].view(np.int64) for salt in (1, 2)]
                columns = (*keys, ids[s.first + row], tags[s.first + row], at - s.bounds[row])
                kinds = (pa.int64(),) * 4 + (pa.int32(),)
                for k in range(0, len(at), _ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[k : k + _ROWS], t) for c, t in zip(columns, kinds)],
                        names=["key", "check", "id", "tag", "pos"],
                    )

    found = _with_spans(docs, coordinates, "inner").select("id", "tag", "text", "span_pos", "span_n")
    return found.mapInArrow(find, "key long, check long, id long, tag long, pos int")


class Spans:
    """The last two columns of a batch, first words and counts, as pairs by row."""

    def __init__(self, batch: pa.RecordBatch):
        self.pos, self.n = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)

    def __getitem__(self, row: int) -> list[tuple[int, int]]:
        return list(zip(self.pos[row].as_py() or (), self.n[row].as_py() or ()))


def _with_spans(docs: DataFrame, coordinates: DataFrame, how: str) -> DataFrame:
    """Texts with the spans that concern them; spans are broadcast if they are few."""
    rows, spans = coordinates.agg(F.count("*"), F.sum(F.size("span_pos"))).first()
    if rows <= BROADCAST_DOCUMENTS and (spans or 0) <= BROADCAST_SPANS:
        coordinates = F.broadcast(coordinates)
    return docs.join(coordinates, ["id", "tag"], how)


def _per_document(rows: DataFrame) -> DataFrame:
    """(id, tag, span_pos, span_n): adjoining windows become one span; a document's length bounds their number.

    Rows of one id with equal texts have the same spans: they may be counted twice here.
    """
    ordered = Window.partitionBy("id", "tag").orderBy("pos", "n")
    before = F.max(F.col("pos") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.select("id", "tag", "pos", "n", F.coalesce(F.col("pos") > before, F.lit(True)).cast("int").alias("opens"))
    merged = (
        opened.withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "tag", "run")
        .agg(F.min("pos").alias("pos"), (F.max(F.col("pos") + F.col("n")) - F.min("pos")).alias("n"))
    )
    spans = merged.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("spans"))
    return stage(spans.select("id", "tag", F.col("spans.pos").alias("span_pos"), F.col("spans.n").alias("span_n")), "spans")


def _sources(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key its first document and the digest found there."""
    return rows.groupBy(*keys).agg(
        F.min("id").alias("source"), F.max("id").alias("last"), F.min_by("check", "id").alias("source_check")
    )


def repeated_spans(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, tag, span_pos, span_n): the windows, as first word and count, that start in an earlier document too.

    ``docs`` has columns id (long), text and tag, a digest that tells rows of one id with
    different texts apart. "Earlier" means a smaller id.
    """
    docs = docs.filter("id IS NOT NULL AND text IS NOT NULL")
    repeated = stage(_repeated_anchors(docs, size, anchor), "anchors")
    paths = stage(_paths(docs, _filter_of(repeated), size, anchor), "paths")
    sources = stage(_sources(paths, "anchor", "key"), "sources")
    branching = sources.groupBy("anchor").count().filter("count > 1").select("anchor", F.lit(True).alias("branches"))
    known = sources.filter("source < last").drop("last")
    met = paths.join(known, ["anchor", "key"], "left").withColumn(
        "whole",
        F.coalesce((F.col("source") < F.col("id")) & (F.col("source_check") == F.col("check")), F.lit(False)),
    )
    met = stage(met.select("anchor", "id", "tag", "pos", "n", "whole", (F.col("source_check") != F.col("check")).alias("differs")), "met")
    whole = met.filter("whole").select("id", "tag", "pos", "n")
    apart = met.filter("NOT whole").join(branching, "anchor", "left").filter("branches OR differs")

    edges = stage(_edges(docs, _per_document(apart.select("id", "tag", "pos", "n")), size), "edges")
    single = _sources(edges, "key").filter("source < last")
    verified = (F.col("source") < F.col("id")) & (F.col("source_check") == F.col("check"))
    parts = edges.join(single, "key").filter(verified).select("id", "tag", "pos", F.lit(1).alias("n"))
    return _per_document(whole.unionByName(parts))


def substring_dedup(
    docs: DataFrame,
    size: int = WINDOW,
    anchor: int = ANCHOR,
    id_column: str = "doc_id",
    text_column: str = "text",
    joiner: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Remove every word inside a run of ``size`` words that an earlier document holds too.

    Returns for each row the id, the carried columns, n_words, n_removed and ``kept``, the
    text that is left: with ``joiner`` its words joined by that, else the bytes of the text
    without the removed words and the blanks after them. Runs are judged on the input, not
    on what is left. Ids are integers; the order of ids decides which copy stays.

    A null or empty text has no words and is left as it is (null becomes empty with a
    joiner); texts shorter than ``size`` lose nothing. Rows with a null id neither lose
    words nor take them from others. Rows that repeat an id count as one document, so
    they do not take words from each other; each loses what its own text repeats. Columns not named are not read.
    """
    no_clash(carry, [id_column, "n_words", "n_removed", "kept"])
    tag = F.xxhash64(docs[text_column]).alias("tag")
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"), tag)
    spans = repeated_spans(rows, size, anchor)
    named = docs.select(
        docs[id_column].cast("long").alias("id"),
        tag,
        docs[text_column].alias("__text"),
        *[docs[c].alias(f"__{k}") for k, c in enumerate(carry)],
    )
    fields = named.select("id", *[f"__{k}" for k in range(len(carry))]).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            spans = Spans(batch)
            kept, n_words, n_removed = [], [], []
            for s in stretches(texts, spaced()):
                for i in range(s.rows):
                    lo, hi = int(s.bounds[i]), int(s.bounds[i + 1])
                    n = hi - lo
                    gone = spans[s.first + i]
                    text = s.data[s.edges[i] : s.edges[i + 1]].tobytes()
                    n_words.append(n)
                    if not gone:
                        n_removed.append(0)
                        if joiner is not None:
                            text = joiner.encode().join(text.split())
                        kept.append(text.decode() if joiner is not None or texts[s.first + i].is_valid else None)
                        continue
                    hit = np.zeros(max(0, n - size + 1), bool)
                    for pos, count in gone:
                        hit[pos : pos + count] = True
                    out = covered(hit, size)[:n] if len(hit) else np.zeros(n, bool)
                    n_removed.append(int(out.sum()))
                    if joiner is not None:
                        words = text.split()
                        kept.append(joiner.encode().join([words[k] for k in np.flatnonzero(~out)]).decode())
                    else:
                        begin = np.append(s.begin[lo:hi], s.edges[i + 1]) - s.edges[i]
                        stay = np.flatnonzero(~out)
                        pieces = [text[begin[k] : begin[k + 1]] for k in stay.tolist()]
                        kept.append((text[: begin[0]] + b"".join(pieces)).decode())
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            columns = [batch.column(0), *[batch.column(3 + k) for k in range(len(carry))]]
            yield pa.RecordBatch.from_arrays(columns + made, names=schema.names)

    schema = with_fields(fields, "n_words long, n_removed long, kept string")
    done = _with_spans(named, spans, "left").mapInArrow(cut, schema)
    return done.select(
        F.col("id").alias(id_column),
        *[F.col(f"__{k}").alias(c) for k, c in enumerate(carry)],
        "n_words",
        "n_removed",
        "kept",
    )
