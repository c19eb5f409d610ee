"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 60
#: Nodes that may be broadcast (two ids each); beyond, Spark shuffles.
BROADCAST_NODES = 300_000


def _followed(to: DataFrame, small: bool) -> DataFrame:
    """(node, to, moved): every node with what it points to two steps on; moved where the second step still led elsewhere."""
    step = lambda a, b: _held(to.select(F.col("node").alias(a), F.col("to").alias(b)), small)
    rows = to.join(step("to", "next"), "to").join(step("next", "last"), "next")
    return rows.select("node", F.col("last").alias("to"), (F.col("next") != F.col("last")).alias("moved"))


def _held(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is its smallest node.

    In a round every node points to the least of itself and its neighbours, pointers are followed to their ends, and the ends take the
    places of their nodes in the edges. An end that no other node points to has a smaller neighbour in the next round, so two rounds halve the
    ends of a component at least. A round sorts nodes by id once, for their least neighbours; pointers of up to BROADCAST_NODES nodes are
    broadcast. Beyond, they meet by joins of plain exchanges, of which adaptive execution splits those of a hub. No group is gathered. Nodes
    without edges don't occur in the result.
    """
    e = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for k in range(rounds):
        if not e.head(1):
            return out
        # u is the larger one: v has nothing smaller by this edge
        ends = F.explode(F.array("u", "v")).alias("node")
        to = table(e.select(ends, F.col("v").alias("to")).groupBy("node").agg(F.min("to").alias("to")))
        small = to.count() <= BROADCAST_NODES
        while (to := table(_followed(to.select("node", "to"), small))).where("moved").head(1):
            pass
        to = to.select("node", "to")
        ends_of = lambda a, b: _held(to.select(F.col("node").alias(a), F.col("to").alias(b)), small)  # noqa: B023, E731
        left = e.join(ends_of("u", "a"), "u").join(ends_of("v", "b"), "v").where("a <> b")
        e = table(left.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        out = table(out.join(ends_of("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))) if k else to.select("node", F.col("to").alias("component"))
    if e.head(1):
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return out
