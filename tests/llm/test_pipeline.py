"""The pipeline next to a plain version of its stages."""

import corpus_pipeline
from tickloom.llm.common import table
from tickloom.llm.queries import ORACLES, QUERIES, vocabulary

from tools.compare import oracle

from . import plain

SMALL = "/root/testdata/sf0.001"


def cut(text, pattern, lower, gone):
    """The text without flagged words and what follows each up to the next word."""
    spots = [m.span() for m in pattern.finditer(plain.low(text) if lower else text)]
    ends = [a for a, _ in spots[1:]] + [len(text)]
    return text[: spots[0][0]] + "".join(text[a:e] for (a, _), e, g in zip(spots, ends, gone) if not g)


def test_pipeline_agrees_with_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    docs = [(d, t) for d, t in docs if plain.rules(t)["kept"]]
    groups = plain.near(docs, 5)
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    found = plain.repeats(docs)
    docs = [(d, cut(t, plain.SPACED, False, found[d][1]) if any(found[d][1]) else t) for d, t in docs if not (found[d][1] and all(found[d][1]))]
    hits = plain.contamination(docs, items)
    docs = [(d, cut(t, plain.ALNUM, True, hits[d][1]) if any(hits[d][1]) else t) for d, t in docs if sum(hits[d][1]) <= 0.5 * hits[d][0]]
    tokenizer = Tokenizer.from_file(vocabulary())
    wanted = {d: tokenizer.encode(t, add_special_tokens=False).ids + [2] for d, t in docs}

    pieces = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == wanted.keys()
    for d, own in pieces.items():
        assert own[0].doc_tokens == len(wanted[d])
        for r in own:
            assert r.ids_crc32 == plain.crc(wanted[d][r.start : r.start + r.length])


def test_near_dedup_removes_rows_not_ids(spark):
    words = lambda k: " ".join(f"{k}{n}" for n in range(30))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(3, b), (5, a), (5, b), (9, c), (9, c), (None, words("d")), (None, words("d") + " x"), (-2, a + " y"), (10, None), (10, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(
        map(str, [(3, b), (9, c), (-2, a + " y"), (10, None), (10, ""), next((r.doc_id, r.text) for r in found if r.doc_id is None)])
    )


def test_queries_agree_with_their_sql(spark, monkeypatch):
    duck = oracle(SMALL)
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SMALL)
        rows = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        place = [names.index(c) for c in sorted(df.columns)]
        assert rows == sorted(tuple(str(r[k]) for k in place) for r in result.fetchall()), name
