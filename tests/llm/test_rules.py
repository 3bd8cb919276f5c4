"""Quality rules on labelled documents and on long texts."""

import base64
import random
from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm.common import prepared, table
from tickloom.llm.quality_rules import CHUNK, DOCUMENT_BANDS, band, quality_rules

TENTH = "/root/testdata/sf0.1"


def test_bands_tell_poor_documents_from_good_ones(spark):
    docs = table(spark, TENTH, "documents").withColumn("bytes", F.octet_length("text"))
    labels = table(spark, TENTH, "labels").filter("quality IS NOT NULL").select("doc_id", "quality")
    judged = quality_rules(docs, carry=("bytes",)).filter("NOT base_failed").join(labels, "doc_id")
    good, poor = judged.filter("quality = 1"), judged.filter("quality = 0 AND bytes >= 1600")
    assert good.count() > 3000 and good.filter("NOT kept").count() == 0
    assert poor.filter("NOT kept").count() > 0.85 * poor.count() > 100


def test_the_only_full_chunk_of_a_text_is_judged(spark):
    draw = random.Random(2)
    code = base64.b64encode(draw.randbytes(3300)).decode()
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(7)) for _ in range(40)]
    prose = " ".join(draw.choice(words) for _ in range(800))
    text = " ".join(code[i : i + 12] for i in range(0, len(code), 12))[:CHUNK] + prose[:3600]
    short = prose[: CHUNK - 1]
    rows = [(1, text), (2, short)]
    found = {r.doc_id: r for r in quality_rules(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    low, high = band(len(text), DOCUMENT_BANDS)
    assert low <= found[1].ratio <= high and not found[1].base_failed
    assert (found[1].n_chunks, found[1].n_bad_chunks, found[1].kept) == (1, 1, False)
    assert found[2].n_chunks == 0


def test_long_texts_agree_with_plain_counts(spark):
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(r)}" for _ in range(n)) for n, r in ((3000, 30), (6000, 40), (250_000, 200))]
    rows = list(enumerate(texts))
    for r in quality_rules(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect():
        words = texts[r.doc_id].split(" ")
        runs = list(zip(words, words[1:], words[2:]))
        often = Counter(runs)
        hit = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(hit), sum(map(len, words)))
        assert r.n_chunks == len(texts[r.doc_id]) // CHUNK and r.base_failed == (100 * len(hit) > 50 * len(words))
