"""Best-fit packing: the subset sums, whole results, and how full sequences get."""

import random
from itertools import combinations

import pytest

from tickloom.llm.bin_slack import Shelf, fullest, pack_full
from tickloom.llm.common import prepared
from tickloom.llm.queries import vocabulary

from . import plain
from .test_packed_ids import wanted


def test_fullest_choice_against_all_choices():
    draw = random.Random(4)
    for _ in range(300):
        pieces = [draw.randrange(1, 30) for _ in range(draw.randrange(0, 9))]
        room = draw.randrange(0, 70)
        counts = {x: pieces.count(x) for x in pieces}
        chosen = fullest(room, sorted(counts, reverse=True), counts)
        assert all(chosen.count(x) <= counts[x] for x in chosen)
        assert sum(chosen) == max(sum(c) for k in range(len(pieces) + 1) for c in combinations(pieces, k) if sum(c) <= room)


def test_shelf_is_left_empty():
    draw = random.Random(6)
    lengths = [draw.randrange(1, 101) for _ in range(3000)]
    shelf = Shelf(100)
    for k, n in enumerate(lengths):
        shelf.add(k, n)
    sequences, left = shelf.fill(0)
    assert all(sum(lengths[k] for k in s) == 100 for s in sequences)
    for k in left:
        shelf.add(k, lengths[k])
    rest, none = shelf.fill(100)
    assert none == [] and sorted(k for s in sequences + rest for k in s) == list(range(3000))
    room = []  # first fit by falling length
    for n in sorted(lengths, reverse=True):
        k = next((k for k, free in enumerate(room) if free >= n), None)
        if k is None:
            k = len(room)
            room.append(100)
        room[k] -= n
    assert len(sequences) + len(rest) <= len(room)


@pytest.mark.parametrize("size, block", [(4096, 4 << 20), (64, 3000)])
def test_pieces_cover_every_document_once(spark, size, block):
    prepared(spark)
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(draw.choice([1, 4, 20, 90, 700]))) for _ in range(150)]
    texts += ["same text here"] * 60 + [None, "", "x" * 30, "wort " * 250_000]
    rows = [(k if k < 200 else None, t, "a", -1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows[:200], "doc_id long, text string, piece string, sequence_id int").repartition(5)
    found = pack_full(docs, vocabulary(), end=1, size=size, block=block).collect()
    ids = {d: x[:-1] + [1] for d, x in wanted(docs).items()}
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == plain.crc(r.ids) and r.length == len(r.ids) and r.doc_tokens == len(ids[r.doc_id])
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [size * k for k in range(len(own))]
        assert all(r.length == size for r in own[:-1]) and [i for r in own for i in r.ids] == ids[d]
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in own]
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= size
    tokens = sum(map(len, ids.values()))
    groups = 1 + tokens // block
    assert len(sequences) <= -(-tokens // size) + groups + 1


def test_odd_rows(spark):
    prepared(spark)
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, ""), (1, "c"), (1, "c"), (2, "wort " * 300_000)], "doc_id long, text string")
    found = pack_full(odd, vocabulary()).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.doc_tokens) for r in found if r.start == 0) == sorted(
        [(True, None, 3), (True, None, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 300_001)]
    )
    named = odd.filter("doc_id = 1").selectExpr("CAST(doc_id AS STRING) AS name", "text AS body")
    assert {r.doc_id for r in pack_full(named, vocabulary(), id_column="name", text_column="body").collect()} == {"1"}
    assert pack_full(odd.limit(0), vocabulary()).count() == 0
