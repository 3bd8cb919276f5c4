"""Language identification: known words first, shorter and shorter character n-grams for others."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import no_clash, stage, with_fields
from .text import U, _power_tables, _words, mix

LONGEST = 5
#: Labelled documents per language that are fitted on, about: those with the smallest hashes.
SAMPLE = 3_000
_FILTER_BITS = 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Text(NamedTuple):
    """Lower-cased rows as code points, a blank before, between and after them."""

    code: np.ndarray
    sums: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def hashes(self, begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        inverse = _power_tables(len(self.code))[1]
        return mix((self.sums[end] - self.sums[begin]) * inverse[begin] + U(salt))


def read(rows: list[str | None]) -> Text:
    low = [(x or "").lower() for x in rows]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])]) + 1  # a row's first code point
    begin, end, _ = _words(code, np.array([0, len(code)]), letters())
    code = np.where(letters()[code], code, np.uint32(32))
    sums = np.zeros(len(code) + 1, U)
    np.cumsum(mix(code.astype(U) + U(7)) * _power_tables(len(code))[0][: len(code)], out=sums[1:])
    return Text(code, sums, begin, end, np.searchsorted(begin, edges))


def portions(rows: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    """Rows in portions of about ``most`` characters."""
    first, size = 0, 0
    for i, x in enumerate(rows):
        n = len(x or "")
        if size and size + n > most:
            yield first, rows[first:i]
            first, size = i, 0
        size += n
    if first < len(rows):
        yield first, rows[first:]


def _grams(t: Text, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that close inside each word, the blanks around it included, and their words."""
    # one position per letter and one for the blank after it; a gram starts at the blank before at the earliest
    counts = end - begin + 1
    word = np.repeat(np.arange(len(begin)), counts)
    last = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[word]
    first = last + 1 - n
    inside = first >= begin[word] - 1
    hashes = np.zeros(len(word), U)
    hashes[inside] = t.hashes(first[inside], last[inside] + 1, n)
    return np.where(inside, hashes, U(0)), word


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, kind, hash, n): words are kind 0, n-grams their length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in set(langs):
                own = [x for x, y in zip(texts, langs) if y == lang]
                for _, rows in portions(own, 1 << 21):
                    t = read(rows)
                    for kind in range(LONGEST + 1):
                        found = t.hashes(t.begin, t.end, 0) if kind == 0 else _grams(t, t.begin, t.end, kind)[0]
                        keys, n = np.unique(found[found != 0], return_counts=True)
                        columns = [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "hash", "n"])

    rows = sample.mapInArrow(count, "lang string, kind int, hash long, n long")
    return rows.groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))


class Entries:
    """Log frequencies, one column a language, by full 64-bit hash."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        self.hashes, self.scores = hashes, scores
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self._bit(hashes)] = True

    @staticmethod
    def _bit(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of those that are held, and their entries."""
        maybe = np.flatnonzero(self.bits[self._bit(hashes)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe]
        return maybe[same], at[same]


class Model(NamedTuple):
    langs: list[str]
    entries: list[Entries]  # words, then n-grams by length from 1


def fit(docs: DataFrame, lang: str, text: str, id_column: str, sample: int = SAMPLE) -> Model:
    """Log frequencies of words and n-grams by language, counted by Spark on a bounded sample.

    Every word and n-gram of the sampled documents is in the model, about ``sample``
    documents a language. Half an occurrence is added to each in every language.
    """
    labelled = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [Entries(np.zeros(0, U), np.zeros((0, 0), np.float32))] * (LONGEST + 1))
    share = F.lit(None)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(1_000_003)) / 1_000_003.0
    counts = stage(_counts(labelled.filter(draw < share).select(lang, text)), "counts")
    # one kind at a time: the driver holds one table of counts
    return model_of(langs, (counts.filter(F.col("kind") == k).select("lang", "hash", "n").toArrow() for k in range(LONGEST + 1)))


def model_of(langs: list[str], counts: Iterable[pa.Table]) -> Model:
    """The model of counts (lang, hash, n) of words and of n-grams by length."""
    entries = []
    for own in counts:
        keys, at = np.unique(own["hash"].to_numpy().view(U), return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        column = pc.index_in(own["lang"], value_set=pa.array(langs, pa.string())).to_numpy()
        np.add.at(table, (at, column), own["n"].to_numpy())
        smoothed = (table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, len(keys)))
        entries.append(Entries(keys, np.log(smoothed).astype(np.float32)))
    return Model(langs, entries)


def score(t: Text, model: Model) -> np.ndarray:
    """Summed log scores by row and language."""
    n_words, n_langs = len(t.begin), len(model.langs)
    by_word = np.zeros((n_words, n_langs), np.float32)
    found = np.zeros(n_words, bool)
    place, entry = model.entries[0].find(t.hashes(t.begin, t.end, 0))
    found[place] = True
    by_word[place] = model.entries[0].scores[entry]
    other = np.flatnonzero(~found)
    if len(other):
        left = None
        for n in range(LONGEST, 0, -1):
            hashes, word = _grams(t, t.begin[other], t.end[other], n)
            if left is None:
                left, values = np.ones(len(word), bool), np.zeros((len(word), n_langs), np.float32)
            open_ = np.flatnonzero(left & (hashes != 0))
            place, entry = model.entries[n].find(hashes[open_])
            values[open_[place]] = model.entries[n].scores[entry]
            left[open_[place]] = False
        sizes = np.bincount(word, minlength=len(other))
        starts = np.cumsum(sizes) - sizes
        # successive n-grams overlap, so their scores are averaged to weigh like a word
        by_word[other] = np.add.reduceat(values, starts, axis=0) / sizes[:, None]
    sums = np.zeros((n_words + 1, n_langs))
    np.cumsum(by_word, axis=0, out=sums[1:])
    return sums[t.bounds[1:]] - sums[t.bounds[:-1]]


def identify(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """lang_pred and score for each row, in the scan.

    Words are runs of letters, lower-cased. A word of the model has its log frequency in
    each language; for another word each position takes the longest n-gram ending there
    that the model holds, from five letters down to one, averaged over the word. ``score``
    is the share of the best language when the summed scores are made to add up to one; of
    equally good languages the first by name is taken.

    A null text, or one without letters, is ``und`` with score 0, as is every text if the
    model has no language. Null ids are passed on and repeated rows judged each by itself;
    only the named and ``carry`` columns are read.
    """
    no_clash(carry, [id_column, "lang_pred", "score"])
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(id_column, *carry).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            names, shares = [], []
            for _, rows in portions(batch.column(len(fields)).to_pylist()):
                t = read(rows)
                if not m.langs:
                    names += [UNKNOWN] * len(rows)
                    shares += [0.0] * len(rows)
                    continue
                totals = score(t, m)
                best = totals.argmax(axis=1)
                top = totals.max(axis=1, keepdims=True)
                share = 1 / np.exp(totals - top).sum(axis=1)
                empty = np.diff(t.bounds) == 0
                names += [UNKNOWN if e else m.langs[b] for e, b in zip(empty, best)]
                shares += np.where(empty, 0.0, share).tolist()
            columns = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                names=[*fields.names, "lang_pred", "score"],
            )

    rows = docs.select(id_column, *carry, docs[text_column].alias("__text"))
    return rows.mapInArrow(judge, with_fields(fields, "lang_pred string, score double"))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
