"""The manifest next to trees built by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle
from tickloom.llm.common import prepared


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf its siblings from below."""
    proofs = [[] for _ in leaves]
    level, spans = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, wider = [], []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            for k, own in enumerate(spans[i : i + 2]):
                for leaf in own:
                    proofs[leaf] += pair[:k] + pair[k + 1 :]
            above.append(H(*pair))
            wider.append(sum(spans[i : i + 2], []))
        level, spans = above, wider
    return level[0], proofs


def told(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest_against_plain_trees(spark, levels):
    prepared(spark)
    draw = random.Random(3)
    rows = [(k, draw.choice(["hot", "hot", "ß", None, "b", "ö"]), draw.choice([None, 3, 44]), draw.choice([None, "", "té:xt"])) for k in range(70)]
    rows += [(5, "hot", 1, "again"), (6, "hot", 3, "x"), (6, "hot", 3, "x"), (None, "hot", 1, "y"), (900, "alone", 1, "z")]
    df = spark.createDataFrame([(*r, -1, "q") for r in rows], "doc_id long, lang string, n long, text string, place int, root string").repartition(4)
    leaf = merkle.leaf(*[F.col(c) for c in ("doc_id", "lang", "n", "text")])
    other = F.when(F.col("doc_id") % 3 == 0, F.lit(b"\7" * 32)).otherwise(leaf)
    found = merkle.manifest(df.select("*", leaf.alias("leaf"), other.alias("offered")), carry=["offered", "n"], levels=levels)

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, told(*r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, _, leaf in sorted(groups[g])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    wanted = sorted(
        (str(i if known else None), leaf, trees[g][0], root, H(*trees[g][1][k], *above[names.index(g)]))
        for g in names
        for k, (known, i, leaf) in enumerate(sorted(groups[g]))
    )
    checked = merkle.verify(found, "leaf").collect()
    assert sorted((str(r.doc_id), r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256) for r in checked) == wanted
    assert all(r.verified and r.folded_root == r.root for r in checked)
    for r in merkle.verify(found, "offered").collect():
        assert r.verified == (r.doc_id is None or r.doc_id % 3 > 0) == (merkle.fold(bytes(r.offered), bytes(r.proof)) == bytes(r.root))


def test_small_and_odd_tables(spark):
    prepared(spark)
    one = spark.createDataFrame([("k", "g", bytes(range(32)))], "name string, part string, sum binary")
    found = merkle.verify(merkle.manifest(one, "name", "part", "sum"), "sum").collect()
    assert [(bytes(r.subroot), bytes(r.root), bytes(r.proof), r.proof_sha256, r.verified) for r in found] == [(bytes(range(32)),) * 2 + (b"", H(), True)]
    empty = merkle.manifest(one.limit(0), "name", "part", "sum")
    assert empty.count() == 0 and merkle.verify(empty, "sum").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(one.withColumn("proof", F.lit(1)), "name", "part", "sum", carry=["proof"])
