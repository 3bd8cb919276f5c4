"""Merkle manifest of a dataset: a leaf per row, a tree per group, one root over the groups.

A node is the SHA-256 of the hex digests of the two nodes below it, or of the one that is
left at the end of a level. Leaves are ordered by id inside their group, groups by name.

Proofs come from pointer jumping. At first every node knows the sibling on its way to its
parent: a segment of one level. A self-join puts the segment of the node that a segment
ends at behind it, which doubles the distance that all segments span; after as many joins
as the height has binary digits every leaf's segment ends at the root. A join at distance d
needs the nodes at multiples of d only, so what is joined shrinks as fast as segments grow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import row_id
from .common import no_clash, prepared, stage, with_fields

#: Levels that one task builds at once, over 2**LEVELS neighbouring nodes.
LEVELS = 8
#: Groups whose names and sizes may be broadcast (some 10 MB), and bytes of upper nodes.
GROUPS, UPPER_BYTES = 100_000, 8 << 20
#: An entry of a segment is one of these bytes, and for the last two the sibling's digest.
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def leaf(*fields: Column) -> Column:
    """Digest of the fields, each as its length in bytes, a colon and its value; null is a dash."""
    told = [x.cast("string") for x in fields]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in told]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def entries(segment: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Mark and sibling, level by level from below."""
    at = 0
    while at < len(segment):
        mark = segment[at : at + 1]
        more = 0 if mark == ALONE else 32
        yield mark, segment[at + 1 : at + 1 + more]
        at += 1 + more


def fold(digest: bytes, segment: bytes) -> bytes:
    """The digest at the end of the segment, computed from the one at its beginning."""
    for mark, sibling in entries(segment):
        digest = parent(sibling, digest) if mark == LEFT else parent(digest, sibling) if mark == RIGHT else parent(digest)
    return digest


def _build(group: pa.Table, most: int) -> pa.Table:
    """All nodes of up to ``most`` levels above neighbouring nodes, with their one-level segments, and the top."""
    group = group.sort_by("idx")
    tree, base, n, first = (group.column(c)[0].as_py() for c in ("tree", "level", "n", "idx"))
    digests = group.column("digest").to_pylist()
    levels = min(most, (n - 1).bit_length())
    level, idx, segment = [], [], []
    for step in range(levels):
        for i in range(len(digests)):
            other = digests[i ^ 1] if i ^ 1 < len(digests) else None
            segment.append(ALONE if other is None else (LEFT if i & 1 else RIGHT) + other)
        level += [base + step] * len(digests)
        idx += range(first >> step, (first >> step) + len(digests))
        digests = [parent(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
    nodes = len(level)
    columns = {
        "tree": pa.array([tree] * (nodes + 1), pa.int64()),
        "level": pa.array([*level, base + levels], pa.int32()),
        "idx": pa.array([*idx, first >> levels], pa.int64()),
        "segment": pa.array([*segment, None], pa.binary()),
        "digest": pa.array([None] * nodes + [digests[0]], pa.binary()),
        "n": pa.array([None] * nodes + [-(-n // (1 << levels))], pa.int64()),
    }
    return pa.table(columns)


def _trees(leaves: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Segments of one level of all nodes, and the root of each tree (tree, digest).

    ``leaves`` has columns tree, idx (from 0 without gaps), digest and n, the tree's leaves.
    """
    schema = "tree long, level int, idx long, segment binary, digest binary, n long"
    current = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest", "n")
    nodes, roots = [], [current.filter("n = 1").select("tree", "digest")]
    current = current.filter("n > 1")
    while True:
        dealt = current.withColumn("block", F.shiftright("idx", levels))
        built = stage(dealt.groupBy("tree", "block").applyInArrow(lambda t: _build(t, levels), schema), "nodes")
        nodes.append(built.filter("segment IS NOT NULL").select("tree", "level", "idx", "segment"))
        tops = built.filter("segment IS NULL").select("tree", "level", "idx", "digest", "n")
        roots.append(tops.filter("n = 1").select("tree", "digest"))
        current = tops.filter("n > 1")
        if current.isEmpty():
            return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, roots)


def _jump(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, idx, segment): for each leaf the siblings on its whole way up."""
    distance = 1
    while distance < height:
        spot = F.col("level") % (2 * distance)
        lower = nodes.filter(spot == 0)
        upper = nodes.filter(spot == distance).select(
            F.col("tree").alias("_tree"),
            (F.col("level") - distance).alias("_level"),
            F.col("idx").alias("_idx"),
            F.col("segment").alias("_segment"),
        )
        if upper.count() * (33 * distance + 24) <= UPPER_BYTES:
            upper = F.broadcast(upper)
        met = (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_level"))
        met &= F.shiftright("idx", distance) == F.col("_idx")
        longer = F.concat("segment", F.coalesce("_segment", F.lit(b"")))
        nodes = stage(lower.join(upper, met, "left").select("tree", "level", "idx", longer.alias("segment")), "segments")
        distance *= 2
    return nodes.filter("level = 0").select("tree", "idx", "segment")


def manifest(
    rows: DataFrame,
    id_column: str = "doc_id",
    group_column: str = "lang",
    leaf_column: str = "leaf",
    carry: Sequence[str] = (),
    levels: int = LEVELS,
) -> DataFrame:
    """The rows with id, group, leaf and carried columns, and place, subroot, root and proof.

    ``leaf`` holds 32-byte digests, for instance from :func:`leaf`. ``place`` counts from 0
    inside the group. ``proof`` has one entry a level from the leaf by way of the group's
    subroot to the root; :func:`fold` turns leaf and proof into the root again. A group of
    one row has its leaf as subroot, a dataset of one group its subroot as root.

    Places come from a range exchange, so a group may hold any share of the rows, and tasks
    build subtrees of neighbours. Null is a group and an id like any other and comes first;
    rows that repeat an id are leaves of their own, in the order of their digests. No rows
    give no rows. Carried names must differ from the columns added.
    """
    added = ("id", "grp", "place", "subroot", "root", "proof")
    no_clash(carry, [*added, id_column, group_column, leaf_column])
    base = rows.select(
        rows[id_column].alias("id"),
        rows[group_column].alias("grp"),
        rows[leaf_column].alias("leaf"),
        *[rows[c].alias(f"_carried_{k}") for k, c in enumerate(carry)],
    )
    order = [F.asc_nulls_first("id"), F.asc_nulls_first("leaf")]
    numbered = row_id(stage(base, "leaves"), "place", order, keys=["grp"]).withColumn("place", F.col("place") - 1)
    sizes = stage(numbered.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "groups")
    groups = stage(row_id(sizes, "tree", [F.asc_nulls_first("grp")]).withColumn("tree", F.col("tree") - 1), "groups")
    many, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    small = (lambda df: F.broadcast(df)) if many <= GROUPS else (lambda df: df)
    named = small(groups.withColumnRenamed("grp", "_grp"))
    placed = numbered.join(named, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
    placed = stage(placed, "placed")

    nodes, subroots = _trees(placed.select("tree", F.col("place").alias("idx"), F.col("leaf").alias("digest"), "n"), levels)
    ways = _jump(nodes, (most - 1).bit_length() if most else 0)
    subroots = stage(subroots, "subroots")
    above, root = _trees(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(many).cast("long").alias("n")),
        levels,
    )
    above = _jump(above, (many - 1).bit_length() if many else 0).select(F.col("idx").alias("tree"), F.col("segment").alias("_above"))
    root = F.broadcast(root.select(F.col("digest").alias("root")))  # one row
    tops = subroots.withColumnRenamed("digest", "subroot").join(above, "tree", "left").join(root, how="left")
    proof = F.concat(F.coalesce("segment", F.lit(b"")), F.coalesce("_above", F.lit(b"")))
    done = placed.join(ways.withColumnRenamed("idx", "place"), ["tree", "place"], "left").join(small(tops), "tree")
    return done.select(
        F.col("id").alias(id_column),
        F.col("grp").alias(group_column),
        F.col("leaf").alias(leaf_column),
        *[F.col(f"_carried_{k}").alias(c) for k, c in enumerate(carry)],
        "place",
        "subroot",
        "root",
        proof.alias("proof"),
    )


def verify(rows: DataFrame, leaf_column: str = "leaf") -> DataFrame:
    """Add proof_sha256, the digest of the siblings' hex digests, folded_root and verified.

    ``rows`` has columns proof and root; the digest in ``leaf_column`` is the one on trial.
    A null digest folds to null and is not verified.
    """
    prepared(rows.sparkSession)
    names = rows.columns
    trial, proof, root = (names.index(c) for c in (leaf_column, "proof", "root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, folded, right = [], [], []
            for digest, way, wanted in zip(*(batch.column(k).to_pylist() for k in (trial, proof, root))):
                sums.append(parent(*[s for _, s in entries(way)]).hex())
                end = None if digest is None else fold(digest, way)
                folded.append(end)
                right.append(end is not None and end == wanted)
            made = [pa.array(sums, pa.string()), pa.array(folded, pa.binary()), pa.array(right, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    schema = with_fields(rows.schema, "proof_sha256 string, folded_root binary, verified boolean")
    return rows.mapInArrow(run, schema)
