"""Connected components of a table of links, by repeated hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstack.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (a, b).

    Each round gives every node the smallest root among its own and its neighbours', hooks the root
    itself to it, and then replaces roots by their roots, so long chains halve. Rounds are written to
    the shared folder. Edges within one component are dropped on the way. Null ends are no links.
    """
    links = stored(
        edges.select("a", "b").dropna().where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = None  # node: root
    while True:
        both = links.select("a", "b").union(links.select("b", "a"))
        # The smallest neighbour of each node that is a root now; itself if it has none smaller.
        least = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("up")
        )
        jumped = _jump(stored(least, "links-up"))
        roots = jumped if roots is None else _follow(roots, jumped)
        roots = stored(roots, "links-roots")
        moved = (
            _renamed(_renamed(links, "a", jumped), "b", jumped)
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        links = stored(moved, "links")
        if links.isEmpty():
            break
    return nodes.join(roots, "node").select("node", "root")


def _renamed(links: DataFrame, side: str, roots: DataFrame) -> DataFrame:
    other = "b" if side == "a" else "a"
    named = links.join(roots.select(F.col("node").alias(side), "root"), side, "left")
    return named.select(F.coalesce("root", side).alias(side), other).select("a", "b")


def _follow(roots: DataFrame, jumped: DataFrame) -> DataFrame:
    up = jumped.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _jump(up: DataFrame) -> DataFrame:
    """Follow pointers to smaller nodes to their ends; every node points to itself or to a smaller one."""
    roots = up.select("node", F.col("up").alias("root"))
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = roots.join(above, "root", "left").select(
            "node", F.col("root").alias("before"), F.coalesce("top", "root").alias("root")
        )
        step = stored(step, "links-jump")
        roots = step.select("node", "root")
        if step.where("root <> before").isEmpty():
            return roots
