"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours to the smallest node it sees.

    The minimum is a partially aggregated hash aggregate and the hand-over is a join that adaptive
    execution may split, so a hub with very many neighbours is no single task's work.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads from a node that has no other to a root: whether all components are stars."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x"))
    sums = seen.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("root"))
    return sums.where("up > 1 or (up = 1 and root = 0)").isEmpty()


def components(links: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in `links(a, b)`; root is the smallest node of its component.

    Self links, repeated links and either direction are fine; an empty table gives an empty table.
    Each round is written to the shared folder, so lineage stays one round deep; the round before is
    deleted then.
    """
    edges = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    for _ in range(most_rounds):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        edges, before = stored(_star(_star(edges, True), False), label), edges
        release(before)
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
