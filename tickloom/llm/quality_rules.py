"""Quality rules: counts over words and lines, and zstandard compression bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import no_clash, with_fields
from .text import spaced, stretches, window_hashes, word_hashes

LEVEL = 3
CHUNK = 4096

#: Bytes of text from which a band holds, smallest and largest ratio of bytes to compressed bytes.
#: A text of 60 bytes shrinks little more than its frame header, one of 30 kB by half and more.
#: From 560 to 12,800 bytes an upper limit lies 0.1 above the ratio that 99 of 100 labelled
#: good documents of that half octave of lengths stay below at sf0.1. Longer ones follow the
#: rise of these limits, as few are labelled there; shorter ones scatter more and share one.
#: Lower limits are wide: nothing labelled lies below good prose.
DOCUMENT_BANDS = (
    (0, 0.30, 1.60),
    (100, 0.80, 1.95),
    (200, 1.00, 1.95),
    (400, 1.15, 1.95),
    (560, 1.15, 1.96),
    (800, 1.40, 2.06),
    (1100, 1.40, 2.14),
    (1600, 1.55, 2.19),
    (2300, 1.55, 2.25),
    (3200, 1.65, 2.32),
    (4500, 1.65, 2.39),
    (6400, 1.80, 2.43),
    (9000, 1.80, 2.47),
    (12800, 1.90, 2.50),
    (18000, 1.90, 2.53),
    (25600, 2.00, 2.56),
    (36000, 2.00, 2.59),
    (51200, 2.00, 2.62),
)
#: Band for fixed chunks of CHUNK bytes (the last, shorter one is not judged by itself). The
#: upper limit is found as those of documents are: 99 of 100 chunks of good ones stay below 2.23.
CHUNK_BAND = (1.50, 2.33)
#: Share of chunks outside the chunk band that rejects a document.
BAD_CHUNKS = 0.34

SYMBOLS = b"#*$%&|<>"

COLUMNS = (
    ("n_words", pa.int64(), "long"),
    ("word_chars", pa.int64(), "long"),
    ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"),
    ("n_repeat_words", pa.int64(), "long"),
    ("ratio", pa.float64(), "double"),
    ("n_bad_chunks", pa.int64(), "long"),
    ("n_chunks", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"),
)


def repeated_windows(words: np.ndarray, size: int) -> int:
    """Words inside runs of ``size`` words that occur twice or more."""
    h = window_hashes(words, size)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int32)
    steps[: len(h)] += hit
    steps[size : size + len(h)] -= hit
    return int((np.cumsum(steps)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def band(n: int, bands) -> tuple[float, float]:
    low, high = bands[0][1:]
    for least, a, b in bands:
        if n < least:
            break
        low, high = a, b
    return low, high


def measure(words: np.ndarray, text: bytes, pack: zstandard.ZstdCompressor, bands, chunk: int, chunk_band) -> tuple:
    n = len(text)
    ratio = n / len(pack.compress(text)) if n else 0.0
    low, high = band(n, bands)
    full = n // chunk
    bad = 0
    for k in range(full):
        r = chunk / len(pack.compress(text[k * chunk : (k + 1) * chunk]))
        bad += not chunk_band[0] <= r <= chunk_band[1]
    return repeated_windows(words, 3), repeated_lines(text), ratio, low <= ratio <= high, bad, full


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bands=DOCUMENT_BANDS,
    chunk: int = CHUNK,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    bad_chunks: float = BAD_CHUNKS,
    level: int = LEVEL,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Counts and a verdict for each row, in the scan: no shuffle.

    A document is kept if the base rules hold (at least 50 words, at most half of them in
    repeated 3-word runs), its zstandard ratio lies in the band for its length, and fewer
    than ``bad_chunks`` of its full chunks of ``chunk`` bytes lie outside ``chunk_band``; a
    text shorter than a chunk has none. High ratios mean repetition; low ones mean text that
    is not prose, such as encoded data.

    A null text has no words and fails the base rules, like an empty one; a null id is
    passed on; repeated rows are judged each by itself. Columns other than the two named
    and those in ``carry``, which are passed on, are not read.
    """
    no_clash(carry, [id_column, *[name for name, _, _ in COLUMNS]])
    fields = docs.select(id_column, *carry).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level)
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        inside = spaced()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            out: list[list] = [[] for _ in COLUMNS]
            for s in stretches(texts, inside):
                hashes = word_hashes(s)
                lead = (s.data & 0xC0) != 0x80  # first bytes of code points
                chars = np.concatenate([[0], np.cumsum(lead & inside[s.data])])
                signs = np.concatenate([[0], np.cumsum(symbol[s.data])])
                for i in range(s.rows):
                    a, b = int(s.edges[i]), int(s.edges[i + 1])
                    words = hashes[s.bounds[i] : s.bounds[i + 1]]
                    text = s.data[a:b].tobytes()
                    repeats, lines, ratio, fits, bad, full = measure(words, text, pack, bands, chunk, chunk_band)
                    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
                    good = not failed and fits and not (full and bad >= bad_chunks * full and bad)
                    row = (len(words), chars[b] - chars[a], signs[b] - signs[a], lines, repeats, ratio, bad, full, failed, good)
                    for column, value in zip(out, row):
                        column.append(value)
            made = [pa.array(x, t) for x, (_, t, _) in zip(out, COLUMNS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(fields))] + made,
                names=[f.name for f in fields] + [n for n, _, _ in COLUMNS],
            )

    schema = with_fields(fields, ", ".join(f"{name} {kind}" for name, _, kind in COLUMNS))
    return docs.select(id_column, *carry, docs[text_column].alias("__text")).mapInArrow(judge, schema)
