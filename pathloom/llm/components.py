"""Consolidating pairwise matches into groups: connected components by seed-tree pruning.

Every round has two steps over the remaining edges.  Minimum selection: each vertex finds the
smallest vertex of its closed neighbourhood and hands it to all neighbours.  Pruning: each vertex
links the minima it was handed to the smallest of them; a vertex that nobody (not even itself)
holds to be a minimum drops out of the graph and hangs below its smallest minimum in a propagation
forest.  The graph shrinks by a constant factor or more a round and is empty after a logarithmic
number of rounds.  Seeds (roots) then pass their identifier down the forest, last dropped first.
A seed is the smallest vertex of its component, compared as text.

Defined results: null ids and self-links make no link; repeated and turned links count once; a
vertex with no link to another one is in no group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.runtime import cut

MAX_ROUNDS = 64


def connected_groups(edges: DataFrame, left: str, right: str) -> DataFrame:
    """vertex, group: every linked vertex with the smallest vertex of its component.

    All work is joins and partly summed aggregations on the vertex: the neighbours of a hub are
    never gathered in one place (its minimum is a partial aggregate, its rows are skew-split in
    the join).  Each round is checkpointed; only its edge count comes to the driver."""
    ends = edges.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    ends = ends.where("a is not null and b is not null and a <> b")
    graph = cut(ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    forest: list[DataFrame] = []
    roots = None
    for _ in range(MAX_ROUNDS):
        if graph.isEmpty():
            break
        graph, dropped, seeds = _round(graph)
        forest.append(dropped)
        roots = seeds if roots is None else roots.unionAll(seeds)
    else:
        raise RuntimeError(f"not settled after {MAX_ROUNDS} rounds")
    if roots is None:
        return graph.select(F.col("a").alias("vertex"), F.col("b").alias("group"))
    # seeds flow down: what dropped out in the last round hangs below seeds or what stayed until then
    known = roots.select(F.col("u").alias("vertex"), F.col("u").alias("group"))
    for dropped in reversed(forest):
        below = dropped.join(known, dropped["parent"] == known["vertex"]).select(dropped["u"].alias("vertex"), "group")
        known = cut(known.unionAll(below))
    return known


def _round(graph: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next graph, vertices dropped (u, parent), and seeds (u) that are alone now."""
    smallest = graph.groupBy("a").agg(F.min("b").alias("m"))
    smallest = smallest.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    handed = graph.join(smallest, graph["a"] == smallest["u"]).select(F.col("b").alias("u"), "m")  # each neighbour gets u's minimum
    held = cut(handed.unionAll(smallest).distinct())
    best = held.groupBy("u").agg(F.min("m").alias("best"), F.bool_or(F.col("u") == F.col("m")).alias("stays"))
    best = cut(best)
    links = held.join(best.select("u", "best"), "u").where("m <> best").select(F.col("m").alias("a"), F.col("best").alias("b"))
    following = cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    dropped = best.where("not stays").select("u", F.col("best").alias("parent"))
    left = following.select(F.col("a").alias("u")).distinct()
    seeds = best.where("stays").select("u").join(left, "u", "left_anti")
    return following, dropped, seeds
