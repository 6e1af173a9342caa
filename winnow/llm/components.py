"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import materialise


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link. ``links``: (a, b) of comparable ids.

    In rounds: every id hooks onto its smallest neighbour if that is smaller, the trees so made are flattened, and links between different
    trees become links of their roots. A round leaves far fewer ids with links, a chain of any length is one tree. Aggregates and joins
    only; each round is written to the shared folder, so a lost executor costs one round's reading.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    known = None
    while known is None or not edges.isEmpty():
        trees = rooted(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), label)
        known = trees if known is None else materialise(_moved(known, trees, "root").unionByName(trees), label)
        edges = _moved(_moved(edges, trees, "a"), trees, "b").where("a <> b")
        edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    low = known.select("id", F.col("root").alias("component"))
    return low.unionByName(low.select(F.col("component").alias("id"), "component").distinct())


def rooted(parents: DataFrame, label: str = "trees") -> DataFrame:
    """(id, root) of a forest given as (id, root): parents that are smaller than their children. Each step triples how far up a row looks."""
    parents = materialise(parents, label)
    while True:
        up = parents.select(F.col("id").alias("_at"), F.col("root").alias("_up"))
        once = parents.join(up, F.col("root") == F.col("_at"), "left").select("id", F.coalesce("_up", "root").alias("root"))
        higher = once.join(up, F.col("root") == F.col("_at"), "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("open"))
        higher = materialise(higher, label)
        parents = higher.select("id", "root")
        if higher.where("open").isEmpty():
            return parents


def _moved(rows: DataFrame, trees: DataFrame, col: str) -> DataFrame:
    """``rows`` with the ids in ``col`` replaced by their roots."""
    roots = trees.select(F.col("id").alias(col), F.col("root").alias("_root"))
    return rows.join(roots, col, "left").select(*[F.coalesce("_root", col).alias(c) if c == col else c for c in rows.columns])
