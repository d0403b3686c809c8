"""Connected components of a table of links, by alternating star steps; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stage


def _min_of(edges: DataFrame) -> DataFrame:
    """For each ``u`` of directed edges (u, v): its edges with ``m``, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _min_of(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _min_of(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the links (a, b).

    Each step halves the paths; it ends when a step changes no edge. Steps are staged on shared storage, so a lost
    executor costs one step. Nulls in a link: the link is left out.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
        stepped = _small_star(_large_star(edges)).filter("u <> v").distinct()
        edges = stage(stepped, "edges")
    parents = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return parents.union(parents.select("component", "component")).distinct()
