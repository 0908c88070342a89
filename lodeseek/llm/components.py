"""Connected components of a distributed edge list, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, merged


def _joined(edges: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of the node at that end.

    The least ones are written before they are joined: between an exchange and a join an aggregation would keep the planner from
    splitting the edges of a hub over several tasks.
    """
    least = least.select(F.col("u").alias("_u"), "m")
    return edges.join(merged(least), edges[end] == least["_u"]).select("u", "v", "m")


def _around(edges: DataFrame) -> DataFrame:
    """(u, m, down, up) of every node u of edges (u, v), u > v: its least neighbour, its number of edges down, and whether it has some up."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m"), F.sum((F.col("v") < F.col("u")).cast("int")).alias("down"), F.max(F.col("v") > F.col("u")).alias("up"))


def _large_star(rows: DataFrame) -> DataFrame:
    """rows: edges (u, v), u > v, with the least neighbour m of v. Each larger neighbour of v moves to the least of v and its neighbours."""
    return rows.select("u", F.least("v", "m").alias("v"))


def _small_star(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows: edges (u, v), u > v, with the least v of u as m. Each smaller neighbour of u moves to the least of them, and so does u."""
    return rows.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) undirected edges -> (id long, component_id long), each node that has an edge with the smallest id it can reach.

    Self-loops and repeated edges are allowed; nulls are left out. Every step is an aggregation, combined inside tasks first, and a join
    of two written tables, whose hot keys the adaptive planner splits; nothing but whether a node is unsettled reaches the driver. The
    least neighbours that a large step needs also tell whether the edges are stars already, and are then the result. No step makes more
    edges than it had, so that only every second one makes them distinct. A step's edges are written before those that it was made of
    are deleted.
    """
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        around = checkpoint(_around(now))
        # With none that has several edges down, or one down and others up, the edges are stars around the smallest id of each component.
        if around.where((F.col("down") > 1) | (F.col("down") > 0) & F.col("up")).isEmpty():
            discard(now)
            return around.select(F.col("u").alias("id"), F.least("u", "m").alias("component_id"))
        large = checkpoint(_large_star(_joined(now, "v", around)))
        discard(now)
        discard(around)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        now = checkpoint(_small_star(_joined(large, "u", least), least))
        discard(large)
        discard(least)
