"""What the query modules share: the registry, and fixtures over the driver's tables with their SQL.

Fixtures: a line of a document is a semantic unit, its capitalised words are entities; embeddings are nodes, their mutual neighbours edges;
customers, suppliers, nations and regions are a graph by their keys; turns of a conversation are questions and answers; labels are grades.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, vectors
from graphloom.plans.ship import ship
from graphloom.plans.tables import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- fixtures ---------------------------------------------------------------------------------------------------

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
UNITS = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, idx, {STRIP.format('l')} AS u FROM lines WHERE {STRIP.format('l')} <> ''),
mentions AS (SELECT doc_id, idx, unnest(regexp_extract_all(u, '[A-Z][a-z]+')) AS e, unnest(range(len(regexp_extract_all(u, '[A-Z][a-z]+')))) AS pos FROM units)
"""
MUTUAL = """
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS raw, round(raw, 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT src, dst, sim, raw, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 16),
m AS (SELECT a.src, a.dst, a.sim, a.raw FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND a.sim > 0.3),
edges AS (SELECT src, dst, raw AS w FROM m UNION ALL SELECT dst, src, raw FROM m)
"""
TREE = """
tree AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b, CAST(2 AS DOUBLE) AS w FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 1 FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 4 FROM customer),
edges AS (SELECT a AS src, b AS dst, w FROM tree UNION ALL SELECT b, a, w FROM tree)
"""
ANSWERS = """
qa AS (SELECT q.conv_id || '-' || q.turn AS qid, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')
"""


def units(t) -> DataFrame:
    rows = t("documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "l"))
    return rows.select("doc_id", "idx", text.strip("l").alias("u")).filter("u <> ''")


def named_units(t) -> DataFrame:
    return units(t).withColumn("entities", F.regexp_extract_all("u", F.lit("[A-Z][a-z]+"), F.lit(0)))


def mentions(t) -> DataFrame:
    return named_units(t).select("doc_id", "idx", F.posexplode("entities").alias("pos", "e"))


def neighbours(t) -> DataFrame:
    return materialize(vectors.self_neighbours(t("embeddings"), 16, "vec_id"), "neighbours")


def mutual_graph(t, near: DataFrame | None = None) -> DataFrame:
    """Of neighbours that are there already, if given."""
    pairs = vectors.mutual_edges(neighbours(t) if near is None else near, 0.3).withColumn("w", F.col("sim"))
    return materialize(graph.both_ways(pairs, "src", "dst", F.col("w")), "mutual")


def key_tree(t) -> DataFrame:
    letter = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    parts = [
        graph.both_ways(t("nation").select(letter("N", "n_nationkey").alias("a"), letter("R", "n_regionkey").alias("b")), w=2.0),
        graph.both_ways(t("supplier").select(letter("S", "s_suppkey").alias("a"), letter("N", "s_nationkey").alias("b")), w=1.0),
        graph.both_ways(t("customer").select(letter("C", "c_custkey").alias("a"), letter("N", "c_nationkey").alias("b")), w=4.0),
    ]
    return reduce(DataFrame.unionByName, parts)


def answers(t) -> DataFrame:
    c = t("conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").join(a, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("question"), "answer")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


