"""Entity resolution: names that are similar or acronyms of each other become synonyms; where they run together, a matcher decides."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.models import Call, Retry, answered, prompt
from graphloom.functions.text import is_acronym, same_members, string_lists
from graphloom.operators.components import connected_components
from graphloom.operators.graph import maximal_cliques, merged_lists
from graphloom.operators.vectors import top_k
from graphloom.plans.tables import materialize


def similar_names(names: DataFrame, k: int = 50, least: float = 0.95) -> DataFrame:
    """(a, b), a < b: names (name, embedding) among each other's k nearest that are similar by `least` or one an acronym of the other."""
    near = top_k(names.withColumnRenamed("name", "x"), names.withColumnRenamed("name", "y"), k, "x", "y", "embedding", drop_self=True)
    met = near.filter((F.round("sim", 9) >= least) | is_acronym("x", "y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def merged_groups(groups: DataFrame, key: str, most: int = 30) -> DataFrame:
    """(key, names): overlapping lists (key, clique) of one key joined while they have at most `most` names; lists of different keys don't overlap."""

    @F.pandas_udf("array<array<string>>")
    def merged(groups: pd.Series) -> pd.Series:
        return pd.Series([merged_lists(sorted(sorted(x) for x in lists), most) for lists in groups])

    # A row a key, many to a batch: a call a key would cost more than the work of a small one.
    lists = groups.groupBy(key).agg(F.collect_list("clique").alias("lists"))
    return lists.select(key, F.explode(merged("lists")).alias("names"))


def resolve(edges: DataFrame, make: Callable[[], Call], most_names: int = 5, most_clique: int = 20, most_merged: int = 30, retry: Retry = Retry(attempts=30)) -> DataFrame:  # noqa: B008
    """(a, b): synonym edges. Edges of components of more than most_names names are given up; the cliques that they made, but those of more than most_clique names, are joined
    while they overlap, and the matcher divides each list. A list that it doesn't divide in `attempts` tries stays one group."""
    parts = materialize(connected_components(edges, "a", "b"), "name-parts")
    big = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_names).select("component")
    big = materialize(parts.join(big, "component", "left_semi"), "big-names")
    kept = edges.join(big.select(F.col("node").alias("a")), "a", "left_anti")
    unsure = edges.join(big.select(F.col("node").alias("a")), "a", "left_semi")
    cliques = maximal_cliques(unsure).filter(F.size("clique") <= most_clique)
    placed = cliques.withColumn("node", F.get("clique", 0)).join(big, "node").select("component", "clique")
    lists = merged_groups(placed, "component", most_merged).filter(F.size("names") > 1)
    return kept.select("a", "b").unionByName(pairs_of(matched(lists, make, retry))).distinct()


def matched(lists: DataFrame, make: Callable[[], Call], retry: Retry = Retry(attempts=30)) -> DataFrame:  # noqa: B008
    """Lists of names (names, and whatever else) with groups, by the matcher: all the names in groups, each at least once; else the list is one group."""
    asked = lists.withColumn("asked", prompt("match", text=F.to_json("names")))
    out = answered(asked, F.col("asked"), make, retry)
    groups = string_lists("text")
    return out.withColumn("groups", F.when(F.coalesce(same_members(groups, "names"), F.lit(False)), groups).otherwise(F.array("names"))).drop("asked", "text", "tokens", "attempts", "error")


def pairs_of(lists: DataFrame) -> DataFrame:
    """(a, b), a < b: the names of each group (groups) with one another."""

    @F.pandas_udf("array<struct<a:string,b:string>>")
    def pairs(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"a": x, "b": y} for g in each for x, y in combinations(sorted(set(g)), 2)] for each in groups])

    return lists.select(F.explode(pairs("groups")).alias("p")).select("p.a", "p.b").distinct()
