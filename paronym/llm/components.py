"""Connected components of any size by hashed hooking and contraction.

Each round every vertex hooks onto the neighbour that a seeded hash ranks first.
That makes trees with one pair of vertices hooked onto each other; the one
ranked first of the pair is the root.  Two jumps take vertices to their
ancestors, edges are drawn between these, and doubles and loops go.  Each tree
has two vertices at least and, as the hash changes, paths and stars shrink
alike: the rounds grow with the logarithm of the vertices.  Every step is an
aggregation that combines on the map side or a join against one row a vertex,
whose hubs the adaptive skew join splits.  Each round is written to the
checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _rank(seed: int, vertex: str) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), vertex).alias("h"), F.col(vertex).alias("v"))


def _parents(edges: DataFrame, seed: int) -> DataFrame:
    """``(v, to)``: an ancestor of every vertex of the edges, itself for a root."""
    both = edges.union(edges.select("b", "a"))
    hooked = both.groupBy("a").agg(F.min(_rank(seed, "b"))["v"].alias("to")).withColumnRenamed("a", "v")
    above = lambda d: d.select(F.col("v").alias("to"), F.col("to").alias("up"))
    root = (F.col("up") == F.col("v")) & (_rank(seed, "v") < _rank(seed, "to"))
    parent = hooked.join(above(hooked), "to").select("v", F.when(root, F.col("v")).otherwise(F.col("to")).alias("to"))
    for _ in range(2):
        parent = parent.join(above(parent), "to").select("v", F.col("up").alias("to"))
    return parent


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(v, root)``: each vertex of an edge between two different vertices, and its component's smallest vertex.

    Ends are integers.  Edges with a null end and loops say nothing; doubles
    and direction don't matter; vertices without any edge aren't listed.
    """
    pairs = edges.select(F.col(f"`{a}`").cast("bigint").alias("a"), F.col(f"`{b}`").cast("bigint").alias("b"))
    now = cut_lineage(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        parent = cut_lineage(_parents(now, len(rounds)))
        rounds.append(parent)
        end = lambda old, new: parent.select(F.col("v").alias(old), F.col("to").alias(new))  # noqa: B023, E731
        moved = now.join(end("a", "x"), "a").join(end("b", "y"), "b").where("x <> y")
        now = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    at = rounds[-1]
    for earlier in reversed(rounds[:-1]):  # from the smallest to the largest, so that the joins add up to a few times the vertices
        at = earlier.join(at.select(F.col("v").alias("to"), F.col("to").alias("next")), "to", "left").select("v", F.coalesce("next", "to").alias("to"))
    at = cut_lineage(at)
    least = at.groupBy("to").agg(F.min("v").alias("root"))
    return at.join(least, "to").select("v", "root")
