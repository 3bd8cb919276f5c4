"""Connected components of a link table by contraction, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each linked node can reach.

    ``links`` has columns a and b; order, direction and repeats do not matter. In every
    round each root hooks to its smallest neighbour if that is smaller, chains of hooks
    are flattened by doubling, and the links are rewritten to roots. At least half of
    the roots that still have a link vanish per round. Rounds are written to the shared
    folder; minima are combined before the shuffle, so that a node with very many links
    costs one row per task.
    """
    roots = None
    edges = stage(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    while not edges.isEmpty():
        # b has the smaller neighbour a; a itself stays unless it is some other link's b.
        hooks = stage(edges.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "node"), "hooks")
        while True:
            further = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stage(
                hooks.join(further, "to", "left").select(
                    "node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")
                ),
                "hooks",
            )
            hooks = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = stage(
                nodes.join(hooks, "node", "left").select("node", F.coalesce("to", "node").alias("root")), "roots"
            )
        else:
            at = hooks.withColumnRenamed("node", "root")
            roots = stage(roots.join(at, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        for side in ("a", "b"):
            moved = hooks.withColumnRenamed("node", side)
            other = "b" if side == "a" else "a"
            edges = edges.join(moved, side, "left").select(F.coalesce("to", side).alias(side), other)
        edges = stage(
            edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "links",
        )
    return nodes.select("node", F.col("node").alias("root")) if roots is None else roots
