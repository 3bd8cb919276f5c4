"""The quality classifier and the language model next to plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import language, quality_model
from tickloom.llm.common import prepared


def test_loss_and_slopes_against_plain_ones():
    draw = np.random.default_rng(4)
    rows = [np.unique(draw.integers(0, 12, draw.integers(0, 7))) for _ in range(25)]
    grades = draw.integers(0, 4, 25)
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(25), [len(r) for r in rows])
    w, raised = draw.normal(size=12), draw.normal(size=3)
    value, g_w, g_raised = quality_model.loss(w, raised, flat, owner, grades)

    def plain(w, raised):
        t = [raised[0]]
        for x in raised[1:]:
            t.append(t[-1] + math.exp(x))
        per_grade = {}
        for own, grade in zip(rows, grades):
            x = sum(w[k] for k in own)
            tails = [1.0, *[1 / (1 + math.exp(b - x)) for b in t], 0.0]
            per_grade.setdefault(grade, []).append(-math.log(tails[grade] - tails[grade + 1]))
        means = [sum(v) / len(v) for v in per_grade.values()]
        return sum(means) / len(means) + quality_model.SHRINK / 2 * sum(x * x for x in w)

    assert math.isclose(value, plain(w, raised), rel_tol=1e-9)
    for k, slope in enumerate([*g_w, *g_raised]):
        step = np.zeros(15)
        step[k] = 1e-5
        up, down = (plain(w + s * step[:12], raised + s * step[12:]) for s in (1, -1))
        assert math.isclose(slope, (up - down) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def test_fit_lowers_the_loss_and_tells_grades_apart():
    draw = random.Random(1)
    rows = [np.array(sorted({grade * 10 + draw.randrange(10) for _ in range(5)} | {40 + draw.randrange(9)}), np.int32) for grade in (0, 1, 2) for _ in range(30)]
    grades = np.repeat([0, 1, 2], 30)
    weights, t = quality_model.fit_ordinal(rows, grades, 3)
    x = np.array([weights[r].sum() for r in rows])
    assert t[0] < t[1] and ((x > t[0]).astype(int) + (x > t[1]) == grades).all()
    assert (weights[100:] == 0).all()


def test_rare_words_count_and_odd_rows_are_graded(spark):
    prepared(spark)
    texts = [("the plain text of a page " + "word " * k, 2) for k in range(12)] + [("the plain text of a page " + "word " * k + "vile", 0) for k in range(3)]
    docs = spark.createDataFrame([(k, t, 1.0, True) for k, (t, _) in enumerate(texts)], "doc_id long, text string, tail double, kept boolean")
    rated = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(texts)] + [(None, 1), (3, None), (99, 1), (4, 7)], "doc_id long, grade int")
    model = quality_model.fit(docs, rated, 3, 2)
    found = {r.doc_id: r.expected_grade for r in quality_model.grade(docs, model, 2).collect()}
    assert max(found[k] for k in (12, 13, 14)) < min(found[k] for k in range(12))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "vile " * 300_000)], "doc_id long, text string")
    rows = quality_model.grade(odd, model, 2).collect()
    assert len(rows) == 4 and len({r.tail for r in rows[:3]}) == 1 and all(0 <= r.expected_grade <= 2 for r in rows)
    assert quality_model.grade(odd.limit(0), model, 2).count() == 0
    assert quality_model.grade(docs.limit(0), quality_model.fit(docs.limit(0), rated, 3, 2), 2).count() == 0


def backoff(text, words, grams, langs):
    """Summed scores by language, from logarithms by word and by n-gram."""
    total = [0.0] * len(langs)
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        if word in words:
            found = [words[word]]
        else:
            found, padded = [], f" {word} "
            for end in range(2, len(padded) + 1):
                for n in range(5, 0, -1):
                    if end - n >= 0 and padded[end - n : end] in grams[n]:
                        found.append(grams[n][padded[end - n : end]])
                        break
                else:
                    found.append([0.0] * len(langs))
        for k in range(len(langs)):
            total[k] += sum(s[k] for s in found) / len(found)
    return total


def test_word_first_backoff_against_a_plain_version(spark):
    prepared(spark)
    draw = random.Random(2)
    make = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(1, 9)))
    texts = [(lang, " ".join(make(letters) for _ in range(30))) for lang, letters in (("xx", "abcde"), ("yy", "cdefgß"), ("zz", "aéio")) for _ in range(6)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    model = language.fit(docs, "lang", "text", "doc_id")
    langs = ["xx", "yy", "zz"]
    assert model.langs == langs
    counts = [{} for _ in range(6)]
    for lang, text in texts:
        for word in text.split():
            padded = f" {word} "
            grams = [(0, word)] + [(n, padded[e - n : e]) for n in range(1, 6) for e in range(2, len(padded) + 1) if e >= n]
            for kind, gram in grams:
                counts[kind].setdefault(gram, [0] * 3)[langs.index(lang)] += 1
    scores = []
    for own in counts:
        totals = [sum(c[k] for c in own.values()) + 0.5 * len(own) for k in range(3)]
        scores.append({g: [math.log((c[k] + 0.5) / totals[k]) for k in range(3)] for g, c in own.items()})
    asked = [" ".join(make("abcdefgßéioXq") for _ in range(draw.randrange(1, 12))) for _ in range(200)] + [t for _, t in texts]
    asked += ["Abc-dE, q1q", "", "12", None, "aé " * 400_000]
    rows = language.identify(spark.createDataFrame([(k, t, "n") for k, t in enumerate(asked)], "doc_id long, text string, score string"), model).collect()
    for r in rows:
        text = asked[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = backoff(text, scores[0], scores, langs)
        top = sorted(total, reverse=True)
        if top[0] - top[1] > 1e-3:
            assert r.lang_pred == langs[total.index(top[0])]
        if len(text) < 1000:
            assert math.isclose(r.score, 1 / sum(math.exp(x - top[0]) for x in total), rel_tol=1e-3)
    tied = language.model_of(["b", "c"], [pa.table({"lang": ["b", "c"], "hash": [1, 1], "n": [1, 1]})] * 6)
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert language.identify(one, tied).first().lang_pred == "b"
    assert language.identify(one.limit(0), model).count() == 0
