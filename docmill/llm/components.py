"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace, tag: str = "cc") -> DataFrame:
    """(node, component) of all nodes in edges (a, b); component is the smallest node reachable.

    Each round sends every node to the neighbour (or itself) of smallest hashed rank and keeps the edges between
    the targets. Ranks are hashed, so that a chain in id order also halves; rounds grow as the logarithm of the
    longest path. Hot nodes meet only in pre-aggregated minima and in joins that AQE can split. Every round's
    tables are written to the shared folder, which cuts the lineage.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = work.save(edges.select("a", "b").where("a <> b").distinct(), f"{tag}_e0")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(rounds)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("u"), F.least("m", rank("a")).getField("n").alias("p"))
        parents = work.save(parents, f"{tag}_p{k}")
        rounds.append(parents)
        left = parents.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = parents.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        after = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        edges = work.save(after, f"{tag}_e{k + 1}")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for parents in rounds[1:]:
        step = parents.select(F.col("u").alias("root"), "p")
        labels = labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    labels = work.save(labels, f"{tag}_labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
