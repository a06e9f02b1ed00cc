"""From questions to contexts: seeds, propagation, cut-off, contents; ranking and merging of contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import entity_key
from graphloom.operators.graph import paths_from, reasoning_nodes, walked
from graphloom.plans.tables import materialize

MOST_HITS = 1 << 22
"""Hits, repeated ones too, that a task holds on average."""


def entity_seeds(questions: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, node_id): exact hits of the keys of a question's entities among postings (entity, node_id), which hold each pair once.

    Hits are far more than questions and postings: they are never shuffled. A block of questions meets a block of nodes in one task, which makes them distinct; the number of blocks
    follows the number of hits, which is counted first.
    """
    asked = questions.select("qid", F.explode("entities").alias("e")).select("qid", entity_key("e").alias("entity")).filter("entity IS NOT NULL").distinct()
    asked, there = materialize(asked, "asked"), materialize(postings.select("entity", "node_id").filter("entity IS NOT NULL"), "postings")
    many = lambda df, name: df.groupBy("entity").agg(F.count(F.lit(1)).alias(name))
    n_asked, n_there, hits = many(asked, "a").join(many(there, "b"), "entity", "full").agg(F.sum("a"), F.sum("b"), F.sum(F.col("a") * F.col("b"))).first()
    least = max(2 * asked.sparkSession.sparkContext.defaultParallelism, -(-(hits or 0) // MOST_HITS), -(-((n_asked or 0) + (n_there or 0)) // MOST_HITS))
    ga = gb = 1
    while ga * gb < least and max((n_asked or 0) / ga, (n_there or 0) / gb) > 1:
        ga, gb = (ga + 1, gb) if (n_asked or 0) / ga >= (n_there or 0) / gb else (ga, gb + 1)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.withColumn("qb", own("qid", ga)).withColumn("nb", each(gb))
    b = there.withColumn("nb", own("node_id", gb)).withColumn("qb", each(ga))
    kq, kn = asked.schema["qid"].dataType, there.schema["node_id"].dataType

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        qids, nodes = asked.column("qid").combine_chunks(), there.column("node_id").combine_chunks()
        names = pc.unique(asked.column("entity").combine_chunks())
        of = lambda t: pc.fill_null(pc.index_in(t.column("entity").combine_chunks(), names), -1).to_numpy(zero_copy_only=False)
        seen_q, seen_n = {}, {}
        code = lambda keys, seen: np.array([seen.setdefault(tuple(x.items()) if isinstance(x, dict) else x, len(seen)) for x in keys.to_pylist()], np.int64)
        q, n, wanted, held = code(qids, seen_q), code(nodes, seen_n), of(asked), of(there)
        first_q, first_n = (np.unique(c, return_index=True)[1] for c in (q, n))
        order = np.argsort(held, kind="stable")
        n, edges = n[order], np.searchsorted(held[order], np.arange(len(names) + 1))
        order = np.argsort(q, kind="stable")
        wanted, starts = wanted[order], np.searchsorted(q[order], np.arange(len(seen_q) + 1))
        lists = [np.unique(np.concatenate([n[edges[e] : edges[e + 1]] for e in wanted[i:j]])) for i, j in zip(starts[:-1], starts[1:], strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        found = nodes.take(pa.array(first_n[np.concatenate(lists)] if lists else np.empty(0, np.int64)))
        return pa.table([qids.take(pa.array(first_q)), pa.ListArray.from_arrays(pa.array(offsets), found)], ["qid", "nodes"])

    schema = T.StructType([T.StructField("qid", kq), T.StructField("nodes", T.ArrayType(kn))])
    return a.groupBy("qb", "nb").cogroup(b.groupBy("qb", "nb")).applyInArrow(run, schema).select("qid", F.explode("nodes").alias("node_id"))


def image_expansion(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node_id): N neighbours of the V nodes among the seeds."""
    v = nodes.filter(F.col("node_type") == "V").select("node_id")
    n = nodes.filter(F.col("node_type") == "N").select(F.col("node_id").alias("dst"))
    return seeds.join(v, "node_id").join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id").join(n, "dst").select("qid", F.col("dst").alias("node_id")).distinct()


def retrieve(neighbours: DataFrame, entities: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 8, share: float = 0.25, reasoning: bool = False) -> DataFrame:
    """(qid, node_id, content): contexts of every question; nodes of types N and O have none.

    neighbours: (qid, node_id, rank). Entry nodes are the first k neighbours, the entity hits and the N neighbours of V nodes among the former.
    """
    near = neighbours.filter(F.col("rank") <= k).select("qid", "node_id")
    entry = materialize(near.unionByName(entities).unionByName(image_expansion(near, edges, nodes)).distinct(), "entries")
    # What is walked to leaves the entries out: the union has no row twice.
    out = entry.unionByName(walked(edges, entry, share))
    if reasoning:
        n = entry.join(nodes.filter(F.col("node_type") == "N").select("node_id"), "node_id").select("node_id").distinct()
        out = out.unionByName(reasoning_nodes(paths_from(edges, n), entry, nodes)).distinct() if n.limit(1).count() else out
    return out.join(nodes.filter(~F.col("node_type").isin("N", "O")).select("node_id", "content"), "node_id").select("qid", "node_id", "content")


def retrieve_parts(neighbours: DataFrame, entities: DataFrame, edges: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """(qid, parts): retrieve() for every sub-question (qid, sub); parts is an array over the sub-questions in their order, each with its sorted context nodes. A sub-question without contexts has an empty list."""
    both = F.struct("qid", "sub").alias("qid")
    found = retrieve(neighbours.select(both, "node_id", "rank"), entities.select(both, "node_id"), edges, nodes, **options)
    asked = neighbours.select("qid", "sub").unionByName(entities.select("qid", "sub")).distinct()
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_set("node_id")).alias("nodes")).select("qid.*", "nodes")
    rows = asked.join(lists, ["qid", "sub"], "left").withColumn("nodes", F.coalesce("nodes", F.array().cast(lists.schema["nodes"].dataType)))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("sub", "nodes"))).alias("parts"))


def ranked(scored: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, node_id, score, rank): by score, ties in the order they came (pos)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "pos")))


def merged_contexts(main: DataFrame, sub: DataFrame, least: float = 0.5) -> DataFrame:
    """(qid, node_id, score, rank) of a question's own contexts (qid, pos, node_id, score) and its sub-questions' (qid, sub, pos, node_id, score): each node once, with its best score."""
    rows = main.select("qid", F.lit(-1).alias("sub"), "pos", "node_id", "score").unionByName(sub.select("qid", "sub", "pos", "node_id", "score")).filter(F.col("score") >= least)
    best = rows.groupBy("qid", "node_id").agg(F.min(F.struct(-F.col("score"), "sub", "pos")).alias("b"))
    order = Window.partitionBy("qid").orderBy("b", "node_id")
    return best.withColumn("rank", F.row_number().over(order)).select("qid", "node_id", (-F.col("b.col1")).alias("score"), "rank")


def baseline_contexts(reranked: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """Reranked contexts that are among the question's first k neighbours, in reranked order."""
    near = neighbours.filter(F.col("rank") <= k).select("qid", "node_id")
    return reranked.join(near, ["qid", "node_id"], "left_semi")
