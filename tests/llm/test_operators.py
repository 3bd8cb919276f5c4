"""The text operators next to plain versions, and their edge cases."""

import hashlib
import base64
import random
import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language, quality_model, substrings, tokens
from tickloom.llm.common import prepared, table
from tickloom.llm.components import components
from tickloom.llm.decontaminate import contamination_report, find_contamination, remove_spans
from tickloom.llm.minhash import near_duplicates
from tickloom.llm.packing import cuts_of, pack
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.queries import RULES, vocabulary
from tickloom.llm.substrings import substring_dedup
from tickloom.llm.token_store import digests, read_tokens, with_starts, write_tokens
from tickloom.llm.tokens import Encoder
from tickloom.llm.url_filter import Rule, filter_urls
from tickloom.llm.warc import read_archive, write_archive
from tickloom.session import staging_path

from . import plain

SMALL, HUNDREDTH = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOWELS = "the of and a in to Straße été ñandú worthless re, end. Und ja".split()


def sentence(draw, n):
    return " ".join(draw.choice(VOWELS) if draw.random() < 0.4 else f"w{draw.randrange(4000)}" for _ in range(n))


def edited(draw, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Near and exact copies, shared passages, odd texts."""
    draw = random.Random(5)
    texts = [sentence(draw, draw.randrange(1, 160)) for _ in range(40)]
    base, passage = sentence(draw, 120), sentence(draw, 30)
    texts += [edited(draw, base, draw.randrange(0, 9)) for _ in range(40)] + [base] * 4
    chain = base
    for _ in range(8):
        chain = edited(draw, chain, 2)
        texts.append(chain)
    texts += [f"{sentence(draw, 20)}\n{passage}\t{sentence(draw, 15)}" for _ in range(8)]
    texts += [None, "", " \n\t ", "one", "One", "one two three", "ein\x1czwei \u00a0drei", "a b " * 300, sentence(draw, 6000)]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    prepared(spark)
    rows = [(i, t, "x", i * 2, True, "k", -1) for i, t in corpus]
    schema = "doc_id long, text string, key string, id long, kept boolean, anchor string, n_words int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def items(spark, corpus):
    text = max((t or "" for _, t in corpus), key=len)
    rows = [(1, " ".join(text.split()[50:75])), (2, "ONE"), (3, None), (4, ""), (None, "zwei drei"), (10, " ".join(text.split()[60:72]))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, corpus, size):
    wanted = plain.near(corpus, size)
    found = {r.doc_id: r for r in near_duplicates(docs, size=size).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == wanted
    assert all(r.kept == (r.component_id == d) for d, r in found.items())


def repeated(draw):
    """(id, text) rows: ids on several texts, on equal rows, and null."""
    a, b, c, d = (sentence(draw, 40) for _ in range(4))
    rows = [(3, b), (4, a), (5, a), (5, b), (7, d), (8, ""), (8, c), (9, c), (9, c), (None, a), (None, None), (6, ""), (6, None)]
    return rows + [(20 + k % 3, edited(draw, c, k % 4)) for k in range(12)]


def test_one_component_for_each_id(spark):
    prepared(spark)
    rows = repeated(random.Random(9))
    merged, up = [(i, t) for i, t in rows if i is not None], {}
    for i, _ in merged:
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, x) in enumerate(merged):
        for j, y in merged[n + 1 :]:
            p, q = plain.shingles(x, 5), plain.shingles(y, 5)
            if p and q and 100 * len(p & q) >= 80 * len(p | q):
                low_, high = sorted((root(i), root(j)))
                up[high] = low_
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, component_id int").repartition(3)
    found = near_duplicates(df, size=5).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in found) == sorted(
        (i is None, i, None if i is None else root(i), i is None or root(i) == i) for i, _ in rows
    )


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_SPANS": 0, "BROADCAST_DOCUMENTS": 0, "MOST_BITS": 1 << 16}])
def test_repeated_ids_lose_only_their_own_repeats(spark, bounds, monkeypatch):
    prepared(spark)
    for name, value in bounds.items():
        monkeypatch.setattr(substrings, name, value)
    draw = random.Random(10)
    rows = repeated(draw) + [(1, sentence(draw, 40)), (2, sentence(draw, 60))]
    rows += [(2, rows[-2][1]), (2, sentence(draw, 9) + " " + rows[-2][1][30:] + " " + rows[0][1])]
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = plain.SPACED.findall(t or "")
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    wanted = []
    for i, t in rows:
        words = plain.SPACED.findall(t or "")
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        wanted.append((str(i), len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, tag int, span_n string").repartition(3)
    found = substring_dedup(df, joiner=" ", carry=("tag", "span_n")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == sorted(wanted)
    assert sum(r.n_removed > 0 for r in found) > 4


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in draw.sample(range(0, 60), 60) if i % 7] + [(100, 130), (130, 115), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links[:-1]:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    assert found == {x: root(x) for x in up}


def test_substring_dedup(docs, corpus):
    wanted = plain.repeats(corpus)
    for joiner in (" ", None):
        for r in substring_dedup(docs, joiner=joiner, carry=("key", "id")).collect():
            words, gone = wanted[r.doc_id]
            assert (r.n_words, r.n_removed, r.id) == (len(words), sum(gone), r.doc_id * 2)
            left = [w for w, g in zip(words, gone) if not g]
            text = dict(corpus)[r.doc_id]
            if joiner:
                assert r.kept == " ".join(left)
            elif not any(gone):
                assert r.kept == text
            else:
                assert plain.SPACED.findall(r.kept) == left


def test_decontamination(docs, corpus, items):
    wanted = plain.contamination(corpus, [(r.item_id, r.text) for r in items.collect()])
    assert sum(any(h) for _, h, _ in wanted.values()) > 2
    for block in (500_000, 7):
        rows = contamination_report(find_contamination(docs, items, block=block)).collect()
        assert len(rows) == len(corpus)
        for r in rows:
            n, hit, names = wanted[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, sum(hit), len(names), any(hit))
            assert r.items_sha256 == plain.sha(",".join(names))
    cut = remove_spans(find_contamination(docs, items, carry=("text",)))
    for r in cut.collect():
        n, hit, _ = wanted[r.doc_id]
        words = plain.ALNUM.findall(plain.low(dict(corpus)[r.doc_id] or ""))
        assert plain.ALNUM.findall(plain.low(r.text or "")) == [w for w, h in zip(words, hit) if not h]
        assert sum(hit) <= 0.5 * n


def test_quality_rules(docs, corpus):
    for r in quality_rules(docs).collect():
        wanted = plain.rules(dict(corpus)[r.doc_id])
        assert {k: r[k] for k in wanted} == wanted


ODD = [
    "Hello, World! it's we'll don't 'quoted' rock'n'roll", "été ÉTÉ Straße naïve ÀÉÎ", "e\u0301 \u0301x a\u0301.", "<|endoftext|> a<|startoftext|>b <|x",
    "İstanbul ΣΑΣ ﬁ Ǆ", "1234 a1b2 3.14 --- ... ?!?", "tabs\tand\x0bvt\x0cff\r\nend", "nul\x00 \x1c\x1d\x85x\u00a0y\u2028z", "日本語 текст 🙂🙂", "", "   ", "x" * 300,
]


def test_encoder_equals_the_library(corpus):
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())
    draw = random.Random(3)
    alphabet = "aZé'ßñÿ.,!<|>09 \t\n\u0301\u00a0İ日$"
    texts = ODD + [t or "" for _, t in corpus] + ["".join(draw.choices(alphabet, k=40)) for _ in range(400)]
    for text in texts:
        wanted = whole.encode(text, add_special_tokens=False).ids
        got = fast(text.encode())
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == wanted, text


@pytest.mark.parametrize("name, chunk, remembered", [("byte_bpe_50k.json", 1 << 20, 1 << 20), (None, 64, 1 << 20), (None, 1 << 20, 50)])
def test_encoder_of_other_files_and_bounds(corpus, monkeypatch, name, chunk, remembered):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CHUNK", chunk)
    file = vocabulary(name) if name else vocabulary()
    whole, fast = Tokenizer.from_file(file), Encoder(file, remembered)
    assert fast.by_pieces == (name is None)
    texts = ODD + ["Hello big World", "no-blank" * 400 + "!", "x1" * 3000, " ".join(f"q{k}z{k * k}" for k in range(300))] + [t or "" for _, t in corpus[:40]]
    for _ in range(2):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        ids, counts = fast.rows(data, edges)
        at = 0
        for text, n in zip(texts, counts.tolist()):
            assert ids[at : at + n].tolist() == whole.encode(text, add_special_tokens=False).ids, text[:60]
            at += n


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_token_store(spark, docs, corpus):
    path = staging_path(spark, "tokens")
    write_tokens(docs, path, vocabulary(), end=1)
    found = {r.doc_id: r for r in with_starts(digests(read_tokens(spark, path))).collect()}
    start = 0
    for d, text in sorted(corpus):
        ids = ids_of(text) + [1]
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (start, len(ids), plain.crc(ids))
        start += len(ids)


def test_token_files_can_be_read_in_part(spark):
    """Encodings and page indexes as promised; a filter on the id reads fewer rows."""
    docs = spark.createDataFrame([(k, f"text number {k} " * 20) for k in range(9000)], "doc_id long, text string").coalesce(1)
    path = staging_path(spark, "tokens")
    write_tokens(docs, path, vocabulary(), end=1)
    files = [f for f in Path(urlparse(path).path).glob("*.parquet")]
    assert files
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
        assert "RLE_DICTIONARY" in columns["ids"].encodings and columns["ids"].compression == "ZSTD"
        assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    some = read_tokens(spark, path).filter("doc_id BETWEEN 4000 AND 4010").select("doc_id", "ids")
    assert some.count() == 11
    some.collect()
    plan = some._jdf.queryExecution().executedPlan()
    scans = re.findall(r"PushedFilters: \[([^\]]*)\]", plan.toString())
    assert any("GreaterThanOrEqual(doc_id,4000)" in s for s in scans)
    fresh = read_tokens(spark, path).filter("doc_id BETWEEN 4000 AND 4010").select("doc_id", "ids")
    fresh.collect()
    leaves = fresh._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 11 <= read < 9000


def test_dynamic_program_finds_the_least_cost():
    draw = random.Random(7)

    def least(places, penalty, size, per_window):
        best = {0: 0.0}
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                n = places[j] - places[i]
                if n <= size:
                    options.append(best[i] + (0 if n & (n - 1) == 0 else size - n))
            best[j] = min(options) + penalty[j] + per_window
        return best[len(places) - 1]

    for _ in range(200):
        size = draw.choice([8, 10, 16])
        gaps = [draw.randrange(1, size + 1) for _ in range(draw.randrange(1, 12))]
        places = np.concatenate([[0], np.cumsum(gaps)])
        penalty = np.array([0.0] + [draw.choice([0.0, 1.0, 3.0]) for _ in gaps])
        chosen = cuts_of(places, penalty, size, 2.0)
        cost, before = 0.0, 0
        for j in chosen:
            n = int(places[j] - before)
            assert 0 < n <= size
            cost += (0 if n & (n - 1) == 0 else size - n) + penalty[j] + 2.0
            before = int(places[j])
        assert before == places[-1] and abs(cost - least(places.tolist(), penalty, size, 2.0)) < 1e-9


def test_carried_names_must_not_clash(docs, items):
    with pytest.raises(ValueError):
        quality_rules(docs.withColumn("ratio", F.lit(1)), carry=("ratio",))
    with pytest.raises(ValueError):
        find_contamination(docs.withColumn("hits", F.lit(1)), items, carry=("hits",))
    with pytest.raises(ValueError):
        substring_dedup(docs, carry=("n_words",))
    model = quality_model.Model(np.zeros(1 << quality_model.WEIGHT_BITS, np.float32), np.zeros(2), 0.5)
    with pytest.raises(ValueError):
        quality_model.grade(docs, model, 2, carry=("kept",))
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("score", F.lit(1)), language.model_of([], []), carry=("score",))


def test_texts_above_a_stretch(spark, items):
    """One text of more than a mebibyte next to short ones, in the operators that read words."""
    draw = random.Random(3)
    shared = sentence(draw, 60)
    long = sentence(draw, 250_000) + " " + shared + " " + sentence(draw, 10)
    assert len(long) > 1 << 20
    rows = [(1, shared), (2, long), (3, long + " end"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=5).collect()}
    assert groups == {1: (56, 1), 2: (len(plain.shingles(long, 5)), 2), 3: (len(plain.shingles(long + " end", 5)), 2), 4: (0, 4)}
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df).collect()}
    wanted = plain.repeats(rows)
    assert found == {d: (len(w), sum(g)) for d, (w, g) in wanted.items()}
    asked = spark.createDataFrame([(7, " ".join(shared.split()[5:25]))], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, len(r.hits)) for r in find_contamination(df, asked).collect()}
    assert hits == {d: (n, sum(h)) for d, (n, h, _) in plain.contamination(rows, asked.collect()).items()}


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_packing(docs, corpus, block):
    rows = pack(docs, vocabulary(), end=2, block=block).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length > 0 and r.ids_crc32 == plain.crc(r.ids)
    for d, text in corpus:
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        ids = ids_of(text) + [2]
        assert [i for r in pieces for i in r.ids] == ids
        assert all(r.doc_tokens == len(ids) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_packing_wastes_little(spark):
    rows = pack(table(spark, "/root/testdata/sf0.1", "documents"), vocabulary(), with_ids=False)
    sizes = [r[0] for r in rows.groupBy("sequence_id").agg(F.sum("length")).collect()]
    padded = sum(s if s & (s - 1) == 0 else 4096 for s in sizes)
    assert sum(sizes) / padded > 0.97


def test_archive(spark):
    pages = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, None, None), (4, "b\nc", ""), (5, "u", "é" * 9000), (1, "http://a/2", "same")]
    path = staging_path(spark, "archive")
    write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    rows = sorted(read_archive(spark, path).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.record_type, r.refers_to) for r in rows] == [
        (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None)
    ]
    for r in rows:
        body = next((h or "").encode() for p, _, h in pages if p == r.page_id)
        assert (bytes(r.payload), r.payload_bytes) == (body, len(body))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        told = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert rest == (body if r.record_type == "response" else b"") + b"\r\n\r\n" and told == len(rest) - 4
    write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), path + "-6", least=6)
    assert {r.record_type for r in read_archive(spark, path + "-6").collect()} == {"response"}


def test_url_filter(spark):
    urls = [
        "https://www.Example.ORG/es/x", "http://example.org/en/12?x", "http://example.org", "http://notexample.org/es/", "http://a.com/fr/b", "http://a.com/de/b#c",
        "http://bad.net/x?ref=1&b=2&a=1", "https://www.bad.net:443/x/?a=1&b=2#t", "http://bad.net/other", "no scheme", "", None, "ftp://u@h:80?q", "x\n://h\n/p",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.net/x?a=1&b=2",)] * 2 + [(None,), ("",)], "url string")
    found = {r.page_id: r for r in filter_urls(pages, listed, RULES).collect()}
    assert [found[i].rule for i in range(6)] == ["example.org/es/", "example.org/en/1", None, "org/", "com/fr/", "com/de/"]
    assert [found[i].verdict for i in range(9)] == ["block", "block", "allow", "allow", "allow", "block", "block", "block", "allow"]
    assert all((found[i].host, found[i].path, found[i].verdict) == ("", "", "allow") for i in (9, 10, 11))
    assert (found[12].host, found[12].path) == ("u@h:80", "") and (found[13].host, found[13].path) == ("h\n", "/p")
    assert filter_urls(pages, listed.limit(0)).filter("verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        filter_urls(pages, listed, [Rule("block", f"h{i}", "/") for i in range(2001)])


def test_language(spark):
    docs = table(spark, HUNDREDTH, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter("NOT held_out"), "lang", "text", "doc_id")
    found = language.identify(docs, model, carry=("held_out", "lang"))
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 -- 3"), (3, "the of and was"), (3, "Und der die")], "doc_id long, text string")
    rows = language.identify(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in rows[3:]] == ["en", "de"] and all(0 < r.score <= 1 for r in rows[3:])
    none = language.fit(odd.withColumn("lang", F.lit(None).cast("string")), "lang", "text", "doc_id")
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def test_quality_model(spark):
    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents")
    rated = table(spark, folder, "labels").select("doc_id", quality_model.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    learn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) > 0
    model = quality_model.fit(docs, rated.filter(learn), 3, 2)
    assert model.thresholds[0] < model.thresholds[1]
    shares = {
        r[0]: r[1]
        for r in quality_model.grade(docs, model, 2).join(rated.filter(~learn), "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("int"))).collect()
    }
    assert shares[0] < 0.15 and shares[1] < 0.2 and shares[2] > 0.75  # from 1,800 ratings
    empty = quality_model.fit(docs, rated.limit(0), 3, 2)
    assert quality_model.grade(docs.limit(3), empty, 2).count() == 3


def test_odd_rows_and_empty_tables(spark, docs, items):
    odd = spark.createDataFrame([(None, "a b c"), (1, None), (1, None), (2, "w " * 400), (2, "w " * 400), (None, None)], "doc_id long, text string")
    for rows in (odd, odd.limit(0), docs.limit(0)):
        n = rows.count()
        for size in (4, 5):
            found = near_duplicates(rows, size=size)
            assert found.count() == n and found.filter("doc_id IS NULL AND NOT kept").count() == 0
        assert substring_dedup(rows).count() == n
        assert contamination_report(find_contamination(rows, items)).count() == n
        assert contamination_report(find_contamination(rows, items.limit(0))).filter("contaminated").count() == 0
        assert quality_rules(rows).count() == n
        assert pack(rows, vocabulary()).filter("start = 0").count() == n
        path = staging_path(spark, "tokens")
        write_tokens(rows, path, vocabulary(), end=1)
        assert with_starts(digests(read_tokens(spark, path))).count() == n
