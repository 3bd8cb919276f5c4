"""Quality classifier: ordinal regression on graded ratings over hashed text.

With K grades and thresholds t(1) < ... < t(K-1), all grades share one weight vector w:

    P(grade >= k | x) = sigmoid(w . x - t(k))

so a document has an expected grade, the sum of these tails, and for selection the
tail probability of reaching a grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import no_clash, stage, with_fields
from .text import U, alphanumeric, mix, raw, stretches, word_hashes

#: Rated documents of each grade that are fitted on, about: those with the smallest hashes.
SAMPLE = 4_000
#: Features share this many weights by their hashes; all features count, in fitting and scoring.
WEIGHT_BITS = 20
STEPS, RATE, SHRINK = 250, 0.08, 1e-3
#: Tail probability from which a document is selected if no sample says otherwise.
SELECT = 0.5


def _signs() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(b"#*$%&|<>!=@^~{}[]\\/_+")] = True
    return table


def _shape(data: np.ndarray, n_words: int, n_distinct: int) -> list[int]:
    """Shares of signs and capitals, the repetition of words and the length, as features in bands."""
    n = max(1, len(data))
    capital = ((data >= 65) & (data <= 90)).sum() / n
    bands = (
        (1, min(9, int(_signs()[data].sum() / n * 60))),
        (2, min(9, int(capital * 20))),
        (3, min(9, int(10 * n_distinct / max(1, n_words)))),
        (4, int(np.log2(n_words + 1))),
    )
    return [1000 * a + b for a, b in bands]


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Places of the weights of each row's features: its distinct words, lower-cased, and its shape."""
    data, edges = raw(column)
    for s in stretches(column, alphanumeric(), lower=True):
        words = word_hashes(s)
        for i in range(s.rows):
            own = words[s.bounds[i] : s.bounds[i + 1]]
            distinct = np.unique(own)
            at = s.first + i
            shape = mix(np.array(_shape(data[edges[at] : edges[at + 1]], len(own), len(distinct)), U))
            yield np.unique(places(np.concatenate([distinct, shape])))


def places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - WEIGHT_BITS)).astype(np.int32)


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    select: float


def selection(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, reach: int) -> float:
    """The tail probability that tells grades apart best on documents a fit has not seen.

    Each half of the sample is judged by the fit on the other. All grades weigh alike; of
    equally good thresholds the middle one is taken.
    """
    tail = np.zeros(len(rows))
    for half in (0, 1):
        inside = np.arange(len(rows)) % 2 == half
        w, t = fit_ordinal([r for r, i in zip(rows, inside) if i], grades[inside], n_grades)
        for k in np.flatnonzero(~inside):
            tail[k] = sigmoid(w[rows[k]].sum(dtype=float) - t[reach - 1])
    places = np.linspace(0.01, 0.99, 197)
    right = np.zeros(len(places))
    for g in np.unique(grades):
        own = tail[grades == g][:, None] >= places
        right += (own if g >= reach else ~own).mean(axis=0)
    return float(np.median(places[right >= right.max() - 1e-9]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def loss(
    w: np.ndarray, raised: np.ndarray, flat: np.ndarray, owner: np.ndarray, grades: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of the grades' mean negative log-likelihoods plus shrinkage, and its slopes in w and ``raised``.

    ``raised`` holds the first threshold and the logarithms of the steps to the others, so
    thresholds stay in order. Entry k says that row ``owner[k]`` has feature ``flat[k]``.
    """
    n, n_grades = len(grades), len(raised) + 1
    share = np.bincount(grades, minlength=n_grades).astype(float)
    weight = (1 / np.maximum(share, 1))[grades] / max(1, (share > 0).sum())
    t = np.cumsum(np.concatenate([raised[:1], np.exp(raised[1:])]))
    x = np.bincount(owner, w[flat], minlength=n)
    tail = np.concatenate([np.ones((n, 1)), sigmoid(x[:, None] - t), np.zeros((n, 1))], axis=1)
    index = np.arange(n)
    p = np.maximum(tail[index, grades] - tail[index, grades + 1], 1e-12)
    slope = tail * (1 - tail)
    gx = -weight * (slope[index, grades] - slope[index, grades + 1]) / p
    gt = np.zeros(n_grades + 1)
    np.add.at(gt, grades, weight * slope[index, grades] / p)
    np.add.at(gt, grades + 1, -weight * slope[index, grades + 1] / p)
    g_raised = np.cumsum(gt[1:n_grades][::-1])[::-1] * np.concatenate([[1.0], np.exp(raised[1:])])
    g_w = np.bincount(flat, gx[owner], minlength=len(w)) + SHRINK * w
    return float(-(weight * np.log(p)).sum() + SHRINK / 2 * (w * w).sum()), g_w, g_raised


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by place and thresholds of the cumulative-link model, by gradient steps on all rows.

    Grades weigh alike, however many rows have them. Places that no row has stay 0.
    """
    every = np.concatenate([*rows, np.zeros(0, np.int32)])
    used, flat = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, raised = np.zeros(len(used)), np.zeros(n_grades - 1)
    first = [np.zeros(len(used)), np.zeros(n_grades - 1)]
    second = [np.zeros(len(used)), np.zeros(n_grades - 1)]
    for step in range(1, STEPS + 1):
        _, g_w, g_raised = loss(w, raised, flat, owner, grades)
        for k, (held, g) in enumerate(((w, g_w), (raised, g_raised))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            held -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << WEIGHT_BITS, np.float32)
    weights[used] = w
    return weights, np.cumsum(np.concatenate([raised[:1], np.exp(raised[1:])]))


def fit(
    docs: DataFrame,
    rated: DataFrame,
    n_grades: int,
    reach: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
) -> Model:
    """Fit on about ``sample`` rated documents of each grade.

    ``rated`` has the id column and ``grade``, 0 to n_grades - 1; several ratings of a
    document count as the lowest. The sample (at most about sample * n_grades ids) is
    broadcast to the scan of the texts; what reaches the driver is the sample's features.
    The point of selection for grade ``reach`` comes from cross-fitting on the sample.
    Without rated documents all weights are 0.
    """
    ratings = rated.filter(F.col(id_column).isNotNull() & F.col("grade").between(0, n_grades - 1))
    ratings = stage(ratings.groupBy(id_column).agg(F.min("grade").cast("int").alias("grade")), "ratings")
    sizes = {r[0]: r[1] for r in ratings.groupBy("grade").count().collect()}
    share = F.lit(None)
    for grade, n in sizes.items():
        share = F.when(F.col("grade") == grade, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    chosen = ratings.filter(draw < share)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(features(batch.column(1))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["grade", "places"])

    rows = docs.select(docs[id_column], docs[text_column].alias("text")).join(F.broadcast(chosen), id_column)
    training = rows.select("grade", "text").mapInArrow(placed, "grade int, places array<int>").toArrow()
    grades = training["grade"].to_numpy()
    lists = [np.asarray(x.values) for x in training["places"]]
    order = sorted(range(len(lists)), key=lambda i: (grades[i], lists[i].tobytes()))  # sums run in one order
    lists, grades = [lists[i] for i in order], grades[order].astype(np.int64)
    several = len(np.unique(grades)) > 1
    select = selection(lists, grades, n_grades, reach) if several else SELECT
    return Model(*fit_ordinal(lists, grades, n_grades), select)


def grade(
    docs: DataFrame,
    model: Model,
    reach: int,
    least: float | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """expected_grade, tail (the probability of grade ``reach`` or more) and kept (tail >= least).

    ``least`` is the model's own point of selection unless given.

    A null text counts as empty and is judged by the shape features of an empty text. Null
    ids are passed on; repeated rows are judged each by itself; columns other than the
    named and ``carry`` ones are not read.
    """
    no_clash(carry, [id_column, "expected_grade", "tail", "kept"])
    least = model.select if least is None else least
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    fields = docs.select(id_column, *carry).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = held.value
        for batch in batches:
            x = np.array([weights[at].sum(dtype=float) for at in features(batch.column(len(fields)))], float)
            tails = sigmoid(x[:, None] - thresholds)
            tail = tails[:, reach - 1]
            made = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)]
            columns = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(columns + made, names=schema.names)

    schema = with_fields(fields, "expected_grade double, tail double, kept boolean")
    return docs.select(id_column, *carry, docs[text_column].alias("__text")).mapInArrow(judge, schema)


def rating(quality: Column, toxic: Column) -> Column:
    """Grades from labels: 0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
