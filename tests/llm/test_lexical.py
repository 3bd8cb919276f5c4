"""Ranked search next to plain scores."""

import math
import random
from collections import Counter

import pytest

from tickloom.llm import lexical
from tickloom.llm.common import prepared

from . import plain


def ranked(docs, items, best):
    """[(item_id, rank, doc_id, score)]"""
    held = [(d, Counter(plain.ALNUM.findall(plain.low(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    count, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 25 + (75 * n * count) // words
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in plain.ALNUM.findall(plain.low(text or "")) if t in c
            )
            if score > 0:
                scores.append((-score, d is not None, d))
        scores.sort()
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(scores[:best], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(12)
    words = ["the", "a", "of", "zwölf", "Straße", "x" * 40, "y" * 17, "12", "b2"] + [f"w{i}" for i in range(60)]
    text = lambda n: draw.choice([" ", ", ", "-"]).join(draw.choice(words[: draw.choice([9, 69])]) for _ in range(n))
    docs = [(k, text(draw.choice([1, 5, 40, 200]))) for k in range(150)] + [(200 + k, "the same text") for k in range(30)]
    docs += [(7, "the of a"), (None, "w1 w2"), (300, None), (301, ""), (302, " .,-"), (303, "The THE the " * 90_000 + "rare")]
    items = [(k, text(draw.choice([1, 3, 12]))) for k in range(40)] + [(50, "the same the TEXT"), (51, None), (52, "nowhere"), (None, "rare w1"), (50, "w2")]
    return docs, items


@pytest.mark.parametrize("bounds", [{}, {"shard_documents": 7, "bundle": 3}, {"owners": (0.02, 0.2, 0.5, 1.0), "shard_postings": 50}])
def test_ranks_against_plain_scores(spark, corpus, bounds):
    prepared(spark)
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in corpus[0]], "doc_id long, text string, score int, shard string").repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in corpus[1]], "item_id long, text string, rank int")
    for best, terms in ((10, 300_000), (2, 60)):
        found = lexical.rank_documents(docs, items, best=best, pass_terms=terms, **bounds).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, ranked(*corpus, best)))


def test_empty_tables(spark, corpus):
    prepared(spark)
    docs = spark.createDataFrame(corpus[0][:9], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1][:3], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs.filter("text IS NULL"), items).columns == ["item_id", "rank", "doc_id", "score"]
