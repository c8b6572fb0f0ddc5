"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed

#: Edges of one task at least.
EDGES = 200_000
#: A node with more than 1 / HUBS of all edges is a hub; at most 2 * HUBS nodes are.
HUBS = 1000


def _nodes(pairs: DataFrame) -> DataFrame:
    """a, m (the least of it and its neighbours), n (its edges), down (those to lesser ones), up (whether one is to a greater one), kept."""
    both = pairs.select("a", "b", F.lit(1).alias("down")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("down")))
    return checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"), F.sum("down").alias("down"), F.max(1 - F.col("down")).alias("up")))


def _state(nodes: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node has two lesser neighbours, or both a lesser and a greater one."""
    s = nodes.agg(F.sum("down").alias("n"), F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)).alias("open")).first()
    return s["n"] or 0, s["open"] == 0


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with m of their a; least: a, m, n (edges of a). The edges of hubs meet the few
    rows of hubs where they lie, so that no hub's edges come together in one task."""
    hub = F.col("n") * HUBS > total
    hubs = least.where(hub).select(F.col("a").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    others = marked.where("hub is null").select("a", "b").join(least.where(~hub).select("a", "m"), "a")
    return marked.where("hub is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(others)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node that has an edge to another one.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014), a few rounds in the
    logarithm of the longest path, until all edges are stars; edges that are from the start need none. Each round's edges, never more than were given, are written
    to the shared checkpoint folder; minima are combined before the shuffle, so a hub is no burden. The
    result is dealt by node, as the joins that follow need it: a last round of few edges leaves them in few partitions.
    """
    pairs = checkpointed(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct())
    # One pass over the ends of the edges tells both whether a round is needed and the minima that it begins with.
    while not (state := _state(nodes := _nodes(pairs)))[1]:
        total = state[0]
        greater = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = _with_least(greater, nodes.select("a", "m", "n"), total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        both = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        # A few edges need no more tasks than they fill.
        pairs = checkpointed(both.coalesce(-(-total // EDGES)))
    leaves = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct()).repartition("node")
