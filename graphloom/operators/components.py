"""Connected components by alternating large-star and small-star steps.

Edges are rewired until every node points at the smallest node of its component. Each step is a grouped minimum
(combined before the shuffle) and an equi-join, which Spark may split where a node is hot; the edges are
written to the shared folder after every step, and the last step's table is deleted. No neighbourhood is ever gathered.
The edges are settled when they are stars: every node that points does so once, at a node that points nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import discard, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Of edges (u, v): one grouped count of ends."""
    end = lambda node, out, into: edges.select(F.col(node).alias("node"), F.lit(out).alias("out"), F.lit(into).alias("into"))
    odd = end("u", 1, 0).unionByName(end("v", 0, 1)).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1 AND out > 0")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def _pointed(edges: DataFrame, least: DataFrame, out: str) -> DataFrame:
    """The ends `out` of edges, each with the least node that their other end u knows. least is a table, not a sum still to be made: only then can Spark split the join where u is hot."""
    return edges.join(least.hint("merge"), "u").select(F.col(out).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that edges, taken both ways, connect. Self edges and nulls make no link; a node of self edges alone is its own component."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    first = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    n, loops = first.agg(F.count(F.lit(1)), F.count_if(F.col("u") == F.col("v"))).first()
    if not n:
        return first.select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = first.filter("u <> v") if loops else first
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        # Large star: all greater neighbours of u go to the least of u and its neighbours.
        least = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, "cc")
        wide = materialize(_pointed(now.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "w"), "cc")
        # Small star: u and all its lesser neighbours go to the least of them.
        discard(least)
        least = materialize(wide.groupBy("u").agg(F.min("v").alias("m")), "cc")
        near = _pointed(wide.withColumnRenamed("v", "w"), least, "w").filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        spent, now = now, materialize(near, "cc")
        discard(least, wide, spent)
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    if loops:
        found = found.unionByName(first.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("component")).join(found, "node", "left_anti"))
    return found
