"""Property graphs as two tables: nodes (node_id, node_type, content, names) and edges (src, dst, w), both directions stored.

Builders return contributions; `assemble` adds them up, so that linking twice adds weight, as linking does. A degree is a sum of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import entity_key, has_word, numbered, part_id, strip
from graphloom.operators.components import connected_components
from graphloom.plans.tables import discard, materialize

MOST_EDGES = 1 << 25
"""Edges of a graph that a task holds at most, 16 bytes each."""
MOST_FOUND = 10_000
"""Cliques that a task holds at most before it gives them away."""


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b", w: Column | float = 1.0) -> DataFrame:
    w = F.lit(w) if isinstance(w, (int, float)) else w
    rows = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), w.cast("double").alias("w"))
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def assemble(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("degree")).withColumnRenamed("src", "node_id")


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: degrees (0 for isolated nodes), edge weights, isolated nodes."""
    d = nodes.select("node_id").join(degrees(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    stats = d.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    w = edges.agg(F.min("w").alias("min_weight"), F.max("w").alias("max_weight"))
    return stats.join(w, F.lit(True))


def sanity(edges: DataFrame) -> DataFrame:
    """One row: largest weight, self edges, and the total weight of undirected edges."""
    return edges.agg(F.max("w").alias("max_weight"), F.count_if(F.col("src") == F.col("dst")).alias("self_edges"), F.round(F.sum("w") / 2, 6).alias("total_weight"))


def folded(edges: DataFrame) -> DataFrame:
    """One row an undirected edge, a < b; only that direction's weight counts."""
    return edges.filter(F.col("src") < F.col("dst")).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("w").alias("w"))


# --- builders ---------------------------------------------------------------------------------------------------


def chunk_chain(chunks: DataFrame) -> DataFrame:
    """Each chunk (node_id, doc, idx) with the one of the next index; a gap in the numbering is not bridged."""
    nxt = chunks.select("doc", (F.col("idx") - 1).alias("idx"), F.col("node_id").alias("b"))
    return chunks.select("doc", "idx", F.col("node_id").alias("a")).join(nxt, ["doc", "idx"]).select("a", "b")


def synonym_groups(edges: DataFrame) -> DataFrame:
    """(name, grp) of names that synonym edges (a, b) connect."""
    return connected_components(edges, "a", "b").select(F.col("node").alias("name"), F.col("component").alias("grp"))


def entity_nodes(mentions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(grp, node_id, names): one node a synonym group, numbered in the order of first appearance.

    mentions: (place, name), place an orderable column. The numbering is global; it runs over one row a group, in ranges: the rows
    before a range are counted first, so that no task sorts them all.
    """
    named = mentions.select("place", entity_key("name").alias("name"))
    if groups is not None:
        named = named.join(groups, "name", "left")
        names = groups.groupBy("grp").agg(F.array_sort(F.collect_set("name")).alias("names"))
    else:
        named, names = named.withColumn("grp", F.lit(None).cast("string")), None
    named = named.withColumn("grp", F.coalesce("grp", "name"))
    firsts = named.groupBy("grp").agg(F.min("place").alias("first"))
    if names is not None:
        firsts = firsts.join(names, "grp", "left").withColumn("names", F.coalesce("names", F.array("grp")))
    else:
        firsts = firsts.withColumn("names", F.array("grp"))
    return numbered_rows(firsts, ["first", "grp"], "n").withColumn("node_id", F.format_string("N%06d", "n")).drop("n")


def numbered_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a number from 0 in the given order: ranges of rows, then counts of the ranges before, then numbers within."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_own")).drop("_p", "_own", "_base")


def relation_entities(relations: DataFrame, entities: DataFrame, unit: str = "unit") -> DataFrame:
    """(r_id, node_id) where any alias of an entity of the same unit stands in the relationship's text as whole words.

    relations: (unit, r_id, text); entities: (unit, node_id, alias).
    """
    met = relations.join(entities, unit).filter(has_word("text", "alias"))
    return met.select("r_id", "node_id").distinct()


def orphan_relations(relations: DataFrame, linked: DataFrame, entities: DataFrame) -> DataFrame:
    """The same for relationships that got no entity of their unit, over all entities: an alias's first word must be a word of the text, which makes it an equi-join."""
    left = relations.join(linked.select("r_id").distinct(), "r_id", "left_anti")
    words = left.select("r_id", "text", F.explode(F.array_distinct(F.split(F.upper("text"), "[^\\p{L}\\p{N}_]+"))).alias("w"))
    named = entities.select("node_id", "alias", F.regexp_extract(F.upper("alias"), "([\\p{L}\\p{N}_]+)", 1).alias("w")).filter("w <> ''").distinct()
    return words.filter("w <> ''").join(named, "w").filter(has_word("text", "alias")).select("r_id", "node_id").distinct()


def postings(nodes: DataFrame) -> DataFrame:
    """(entity, node_id): names of N and O nodes, a row each, which is what lookups join."""
    return nodes.filter(F.col("node_type").isin("N", "O")).select(F.explode("names").alias("entity"), "node_id").distinct()


def inverted_index(nodes: DataFrame) -> DataFrame:
    """(entity, nodes): the postings as lists, for output."""
    return postings(nodes).groupBy("entity").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))


def default_k(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: floor(ln(V) * sqrt(sum of degrees / V))."""
    v, d = nodes.agg(F.count(F.lit(1)).alias("v")), edges.agg(F.sum("w").alias("d"))
    return v.join(d, F.lit(True)).select(F.floor(F.log("v") * F.sqrt(F.col("d") / F.col("v"))).alias("k"))


def attribute_nodes(nodes: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that attributes (entity_id, summary) add: an A node with the summary for each, linked with its entity, which must be an N node, and a summary must say something."""
    made = attributes.join(nodes.select(F.col("node_id").alias("entity_id"), "node_type"), "entity_id", "left")
    bad = F.coalesce(F.col("node_type"), F.lit("")) != "N"
    blank = F.length(strip(F.coalesce("summary", F.lit("")))) == 0
    checked = F.when(bad | blank, F.raise_error(F.concat(F.lit("no summary of an entity: "), F.coalesce("entity_id", F.lit("null"))))).otherwise(F.col("summary"))
    made = made.select(part_id("entity_id", "A", F.lit(0)).alias("node_id"), F.lit("A").alias("node_type"), checked.alias("content"), F.col("entity_id").alias("source"))
    return made, both_ways(made.select(F.col("source").alias("a"), F.col("node_id").alias("b")))


def community_texts(nodes: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """(h, texts): the numbered contents of each community's (h, node) members but R, N and V nodes, in order of their ids; communities of fewer than `least` texts are left out."""
    told = members.join(nodes.select(F.col("node_id").alias("node"), "node_type", "content"), "node").filter(~F.col("node_type").isin("R", "N", "V"))
    rows = told.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("node", "content"))).alias("l")).filter(F.size("l") >= least)
    return rows.select("h", numbered(F.transform("l", lambda x: x["content"])).alias("texts"))


def community_nodes(summaries: DataFrame, members: DataFrame, clusters: DataFrame, h_clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of communities: summaries (h, summary, overview) give an H node and its O node, whose names are the keywords; H is linked with O and with those members
    (h, node) that lie in a cluster (node, cluster) near to it (h, cluster)."""
    h = summaries.select(F.col("h").alias("node_id"), F.lit("H").alias("node_type"), F.col("summary").alias("content"), F.lit(None).cast("array<string>").alias("names"))
    o = summaries.select(part_id("h", "O", F.lit(0)).alias("node_id"), F.lit("O").alias("node_type"), F.array_join("overview", ", ").alias("content"), F.transform("overview", entity_key).alias("names"))
    links = high_level_edges(members.join(summaries.select("h"), "h", "left_semi"), clusters, h_clusters).select(F.col("h").alias("a"), F.col("node").alias("b"))
    return h.unionByName(o), both_ways(links.unionByName(summaries.select(F.col("h").alias("a"), part_id("h", "O", F.lit(0)).alias("b"))))


def important(nodes: DataFrame, edges: DataFrame, k: float) -> DataFrame:
    """N nodes of degree k at least."""
    return nodes.filter(F.col("node_type") == "N").join(degrees(edges), "node_id").filter(F.col("degree") >= k).select("node_id", "degree")


def high_level_edges(members: DataFrame, clusters: DataFrame, h_clusters: DataFrame) -> DataFrame:
    """(h, node): members (h, node) of a community whose cluster (node, cluster) is among those nearest to the community's own node (h, cluster)."""
    return members.join(clusters, "node").join(h_clusters, ["h", "cluster"]).filter(F.col("h") != F.col("node")).select("h", "node").distinct()


# --- walks ------------------------------------------------------------------------------------------------------


def shallow_ppr(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, rounds: int = 3) -> DataFrame:
    """(qid, node_id, pi) for all queries at once. seeds: (qid, node_id); every distinct seed starts with mass 1, and seeds are left out of the result.

    A round moves (1 - alpha) of what each node holds to its neighbours by weight; after the last, what is left is kept where it is.
    """
    start = seeds.select("qid", "node_id").distinct()
    moves = edges.join(degrees(edges).withColumnRenamed("node_id", "src"), "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("p"))
    moves = materialize(moves, "ppr-moves")
    r = start.withColumn("r", F.lit(1.0))
    kept = []
    for _ in range(rounds):
        kept.append(r.select("qid", "node_id", (F.col("r") * alpha).alias("pi")))
        spread = r.join(moves, F.col("node_id") == F.col("src")).groupBy("qid", F.col("dst").alias("node_id")).agg(F.sum(F.col("r") * (1 - alpha) * F.col("p")).alias("r"))
        r = materialize(spread, "ppr")
    kept.append(r.select("qid", "node_id", F.col("r").alias("pi")))
    total = reduce(DataFrame.unionByName, kept).groupBy("qid", "node_id").agg(F.sum("pi").alias("pi"))
    return total.join(start, ["qid", "node_id"], "left_anti")


def mass_cut(scores: DataFrame, share: float = 0.25) -> DataFrame:
    """Best scores until their mass reaches the share of the whole; all that tie with the best stay."""
    r = F.round("pi", 9)
    order = Window.partitionBy("qid").orderBy(r.desc(), "node_id")
    every = Window.partitionBy("qid")
    rows = scores.withColumns({"_before": F.coalesce(F.sum(r).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_all": F.sum(r).over(every), "_top": F.max(r).over(every)})
    return rows.filter((F.round("_before", 9) < F.round(share * F.col("_all"), 9)) | (r == F.col("_top"))).drop("_before", "_all", "_top")


def walked(edges: DataFrame, seeds: DataFrame, share: float = 0.25, alpha: float = 0.5, rounds: int = 3) -> DataFrame:
    """(qid, node_id): what mass_cut keeps of shallow_ppr, for weights above 0. What a question reaches is never written down nor sent: nodes are numbered, a task has the whole
    graph, 16 bytes an edge, and walks from one question after the other. Graphs of more than MOST_EDGES edges go the way of tables."""
    graph = materialize(edges.select("src", "dst", "w"), "walk-edges")
    if graph.count() > MOST_EDGES:
        return mass_cut(shallow_ppr(graph, seeds, alpha, rounds), share).select("qid", "node_id")
    ends = graph.select(F.col("src").alias("node_id")).unionByName(graph.select(F.col("dst").alias("node_id"))).distinct()
    nodes = materialize(numbered_rows(ends, ["node_id"], "n").select("node_id", F.col("n").cast("int").alias("n")), "walk-nodes")
    many = nodes.count()
    start = materialize(seeds.select("qid", "node_id").distinct().join(nodes, "node_id").select("qid", "n"), "walk-seeds")
    tasks = max(1, min(start.select("qid").distinct().count(), 2 * edges.sparkSession.sparkContext.defaultParallelism))
    number = lambda e: nodes.select(F.col("node_id").alias(e), F.col("n").alias(f"n_{e}"))
    moves = graph.join(degrees(graph).withColumnRenamed("node_id", "src"), "src").join(number("src"), "src").join(number("dst"), "dst")
    moves = materialize(moves.select("n_src", "n_dst", (F.col("w") / F.col("degree")).alias("p")), "walk-moves")
    sent = moves.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(asked: pa.Table, moves: pa.Table) -> pa.Table:
        ids, n = asked.column("qid").combine_chunks(), asked.column("n").to_numpy()
        src, dst, p = (moves.column(c).to_numpy() for c in ("n_src", "n_dst", "p"))
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        seen: dict = {}  # rows of one question, whatever the type of its id
        code = np.array([seen.setdefault(tuple(x.items()) if isinstance(x, dict) else x, len(seen)) for x in ids.to_pylist()], np.int64)
        order = np.argsort(code, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(ids) else []:
            r = np.zeros(many)
            r[n[at]] = 1.0
            pi, reached = np.zeros(many), r > 0
            for _ in range(rounds):
                pi += alpha * r
                r = np.bincount(dst, (1 - alpha) * r[src] * p, many)
                reached |= r > 0
            pi += r
            reached[n[at]] = False
            there = np.flatnonzero(reached)
            mass = np.round(pi[there], 9)
            best = np.lexsort((there, -mass))
            there, mass = there[best], mass[best]
            before = np.concatenate([[0.0], np.cumsum(mass)])
            keep = (np.round(before[:-1], 9) < np.round(share * before[-1], 9)) | (mass == mass[:1])
            found.append(there[keep])
            rows.append(np.full(int(keep.sum()), at[0]))
        return pa.table([ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found).astype(np.int32))], ["qid", "n"])

    by_task = start.withColumn("task", F.pmod(F.xxhash64("qid"), F.lit(tasks)).cast("int")).groupBy("task")
    kept = by_task.cogroup(sent.groupBy("task")).applyInArrow(run, T.StructType([T.StructField("qid", seeds.schema["qid"].dataType), T.StructField("n", T.IntegerType())]))
    return kept.join(nodes, "n").select("qid", "node_id")


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(source, node_id, dist, path): paths of least sum of 1 / weight from each source; of equal ones that by the smaller last node before.

    All sources relax together until the frontier, what got nearer in the last round, is empty; a round is a step of the longest path, and beyond most_rounds it fails.
    Rounds carry distances and predecessors alone; the paths are put together at the end, twice as long in every step.
    """
    steps = materialize(edges.select("src", "dst", (1 / F.col("w")).alias("cost")), "steps")
    node = edges.schema["src"].dataType
    best = materialize(sources.select("source", F.col("source").cast(node).alias("node_id"), F.lit(0.0).alias("dist"), F.lit(None).cast(node).alias("up")).distinct(), "paths")
    front = best
    for _ in range(most_rounds):
        grown = front.join(steps, F.col("node_id") == F.col("src")).filter(F.col("dst") != F.col("source").cast(node))
        grown = grown.select("source", F.col("dst").alias("node_id"), F.round(F.col("dist") + F.col("cost"), 9).alias("dist"), F.col("node_id").alias("up"))
        merged = grown.unionByName(best).groupBy("source", "node_id").agg(F.min(F.struct("dist", "up")).alias("b")).select("source", "node_id", "b.dist", "b.up")
        merged = materialize(merged, "paths")
        nearer = merged.join(best.select("source", "node_id", F.col("dist").alias("_d")), ["source", "node_id"], "left").filter(F.col("_d").isNull() | (F.col("dist") < F.col("_d"))).drop("_d")
        spent, front = (best, front), materialize(nearer, "front")
        best = merged
        discard(*spent)
        if not front.limit(1).count():
            break
    else:
        raise RuntimeError(f"paths not settled in {most_rounds} rounds")
    # Each row has the end of its path, and which node it goes on from.
    rows = best.withColumn("path", F.array(F.col("node_id").cast("string")))
    while rows.filter("up IS NOT NULL").limit(1).count():
        ends = rows.select("source", F.col("node_id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        whole = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        longer = rows.join(ends, ["source", "up"], "left").select("source", "node_id", "dist", F.col("_up").alias("up"), whole.alias("path"))
        spent, rows = rows, materialize(longer, "paths")
        discard(spent)
    return rows.select("source", "node_id", "dist", "path")


def paths_from(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Shortest paths from entries (node_id), from all nodes where there are none of them."""
    if entries is None or not entries.limit(1).count():
        entries = edges.select(F.col("src").alias("node_id"))
    return shortest_paths(edges, entries.select(F.col("node_id").alias("source")).distinct())


def reasoning_nodes(paths: DataFrame, entries: DataFrame, nodes: DataFrame, only_new: bool = True) -> DataFrame:
    """(qid, node_id) on the paths of three nodes or more between two N entries of a question; only_new leaves the entries out."""
    n = entries.join(nodes.filter(F.col("node_type") == "N").select("node_id"), "node_id")
    pairs = n.select("qid", F.col("node_id").alias("source")).join(n.select("qid", "node_id"), "qid").filter(F.col("source") < F.col("node_id"))
    found = pairs.join(paths, ["source", "node_id"]).filter(F.size("path") >= 3).select("qid", F.explode("path").alias("node_id")).distinct()
    return found.join(entries.select("qid", "node_id"), ["qid", "node_id"], "left_anti") if only_new else found


# --- groups -----------------------------------------------------------------------------------------------------


def spread_labels(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node_id, community) by weighted label propagation: in each round a node takes its neighbours' heaviest label (ties to the smaller), every other node by turn, so that pairs don't swap for ever. Ends when both halves rest; fails beyond `rounds`."""
    now = materialize(edges.select(F.col("src").alias("node_id")).distinct().withColumn("community", F.col("node_id")), "labels")
    still = 0
    for k in range(rounds):
        votes = edges.join(now.select(F.col("node_id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct(-F.round("w", 9), "community")).alias("b")).select(F.col("src").alias("node_id"), F.col("b.community").alias("new"))
        turn = F.pmod(F.xxhash64("node_id", F.lit(k // 2)), F.lit(2)) == k % 2
        moved = now.join(best, "node_id", "left").withColumn("next", F.when(turn & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("community")))
        moved = materialize(moved.select("node_id", "community", "next"), "labels")
        still = 0 if moved.filter("next <> community").limit(1).count() else still + 1
        now = moved.select("node_id", F.col("next").alias("community"))
        if still == 2:
            return now
    raise RuntimeError(f"labels not settled in {rounds} rounds")


def communities(edges: DataFrame, rounds: int = 12, levels: int = 10) -> DataFrame:
    """(node_id, community), which greedily maximises modularity: a stand-in for Leiden, whose objective it has.

    A round moves every other node to the neighbouring community of the greatest gain; rounds go on while modularity grows, and the best division is kept. Then communities
    become nodes, and so on, until a level gains nothing. edges are undirected, stored both ways.
    """
    level = materialize(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "community-edges")
    found = materialize(level.select(F.col("src").alias("node_id")).distinct().withColumn("community", F.col("node_id")), "communities")
    last = modularity(level, found)
    for _ in range(levels):
        parts, best = _moved(level, rounds)
        if best <= last + 1e-9:
            break
        last = best
        inner = parts.select(F.col("node_id").alias("community"), F.col("community").alias("outer"))
        found = materialize(found.join(inner, "community").select("node_id", F.col("outer").alias("community")), "communities")
        p, q = (parts.select(F.col("node_id").alias(e), F.col("community").alias(f"c_{e}")) for e in ("src", "dst"))
        level = materialize(level.join(p, "src").join(q, "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")), "community-edges")
    return found


def _moved(edges: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """The best division that rounds of moves from single nodes reach, and its modularity. edges may hold loops."""
    degree = materialize(edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("k")), "community-degrees")
    m2 = degree.agg(F.sum("k")).first()[0] or 0.0
    now = materialize(degree.select("node_id", "k", F.col("node_id").alias("community")), "communities")
    best, top = now.select("node_id", "community"), modularity(edges, now.select("node_id", "community"))
    idle = 0
    for r in range(rounds):
        total = now.groupBy("community").agg(F.sum("k").alias("total"))
        to = edges.filter("src <> dst").join(now.select(F.col("node_id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node_id"), "community").agg(F.sum("w").alias("w"))
        # Staying is an offer, too, with the node's own degree taken out of its community.
        offers = to.unionByName(now.select("node_id", "community", F.lit(0.0).alias("w"))).groupBy("node_id", "community").agg(F.sum("w").alias("w"))
        offers = offers.join(total, "community").join(now.select("node_id", "k", F.col("community").alias("own")), "node_id")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / m2, 9)
        chosen = offers.groupBy("node_id").agg(F.min(F.struct((-gain).alias("g"), (F.col("community") != F.col("own")).alias("moves"), "community")).alias("b"))
        turn = F.pmod(F.xxhash64("node_id", F.lit(r // 2)), F.lit(2)) == r % 2
        moved = now.join(chosen.select("node_id", F.col("b.community").alias("new")), "node_id").select("node_id", "k", F.when(turn, F.col("new")).otherwise(F.col("community")).alias("community"))
        now = materialize(moved, "communities")
        q = modularity(edges, now.select("node_id", "community"))
        idle = 0 if q > top + 1e-9 else idle + 1
        if not idle:
            best, top = now.select("node_id", "community"), q
        if idle == 2:
            break
    return best, top


def modularity(edges: DataFrame, parts: DataFrame) -> float:
    """Of a division (node_id, community) of undirected edges stored both ways."""
    a = edges.join(parts.select(F.col("node_id").alias("src"), F.col("community").alias("p")), "src").join(parts.select(F.col("node_id").alias("dst"), F.col("community").alias("q")), "dst")
    m2, inside = a.agg(F.sum("w"), F.sum(F.when(F.col("p") == F.col("q"), F.col("w")).otherwise(0.0))).first()
    spread = a.groupBy("p").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return inside / m2 - spread / (m2 * m2) if m2 else 0.0


def maximal_cliques(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(clique: sorted names), of two names at least.

    Names are put in order of their degree; each clique belongs to its first name, which looks for it among its neighbours and the edges between them. The
    names after the first one's are few wherever its place is (at most the root of twice the edges), so that no task holds a component.
    """
    pairs = materialize(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "clique-edges")
    degree = pairs.select(F.col("x").alias("v")).unionByName(pairs.select(F.col("y").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    degree = materialize(degree, "clique-degrees")
    ranked = pairs.join(degree.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y")
    swap = (F.col("dx") > F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") > F.col("y")))
    ahead = materialize(ranked.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("lo"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("hi")), "clique-order")
    wedges = ahead.join(ahead.select("lo", F.col("hi").alias("hi2")), "lo").filter(F.col("hi") < F.col("hi2"))
    triangles = materialize(wedges.join(pairs, (F.col("hi") == F.col("x")) & (F.col("hi2") == F.col("y"))).select("lo", "hi", "hi2"), "triangles")
    row = lambda df, v, x, y, kind: df.select(F.col(v).alias("v"), F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(kind).alias("kind")).alias("r"))
    near = [row(ahead, "lo", "hi", "hi", "after"), row(ahead, "hi", "lo", "lo", "before")]
    around = [row(triangles, *t, "link") for t in (("lo", "hi", "hi2"), ("hi", "lo", "hi2"), ("hi2", "lo", "hi"))]
    # A row a vertex, not a group: a group's own table took longer than its cliques.
    met = reduce(DataFrame.unionByName, near + around).groupBy("v").agg(F.collect_list("r").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b.column(1).flatten(), np.cumsum([0, *b.column(1).value_lengths().to_pylist()])
            xs, ys, kinds = (flat.field(n).to_pylist() for n in ("x", "y", "kind"))
            found: list[list[str]] = []
            for v, i, j in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                near: dict = {x: set() for x, kind in zip(xs[i:j], kinds[i:j], strict=True) if kind != "link"}
                for x, y, kind in zip(xs[i:j], ys[i:j], kinds[i:j], strict=True):
                    if kind == "link":
                        near[x].add(y)
                        near[y].add(x)
                after = {x for x, kind in zip(xs[i:j], kinds[i:j], strict=True) if kind == "after"}
                for c in cliques_of(near, after, set(near) - after):
                    if c:
                        found.append([str(x) for x in sorted([v, *c])])
                        if len(found) == MOST_FOUND:
                            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["clique"])
                            found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["clique"])

    return met.mapInArrow(run, "clique array<string>")


def cliques_of(near: dict, among: set, without: set) -> Iterator[list]:
    """Cliques among some vertices that no other of them, and none of those without, would extend; each step branches around the vertex of most neighbours."""
    stack: list[tuple[list, set, set]] = [([], set(among), set(without))]
    while stack:
        have, could, done = stack.pop()
        if not could:
            if not done:
                yield have
            continue
        pivot = max(could | done, key=lambda v: (len(near[v] & could), v))
        for v in sorted(could - near[pivot]):
            stack.append(([*have, v], could & near[v], done & near[v]))
            could, done = could - {v}, done | {v}


def merged_lists(lists: list[list[str]], most: int = 30) -> list[list[str]]:
    """Overlapping lists joined while their union has at most `most` items, until nothing changes; sorted.

    A list joins the first one before it that it may, in as many rounds as bring changes. Only lists with an item in common are looked at, and of those that
    rested in the round before only such as have changed.
    """
    sets = [(set(x), True) for x in lists]
    changed = True
    while changed:
        changed = False
        out: list[set] = []
        was: list[bool] = []
        now: list[bool] = []
        holders: dict = {}
        changes: dict = {}
        for s, new in sets:
            where = holders if new else changes
            for i in sorted(set().union(*[where[x] for x in s if x in where])):
                if len(s | out[i]) <= most:
                    added = s - out[i] if was[i] or now[i] else s | out[i]
                    out[i] |= s
                    changed = now[i] = True
                    break
            else:
                i, added = len(out), s
                out.append(set(s))
                was.append(new)
                now.append(False)
            for x in added:
                holders.setdefault(x, set()).add(i)
                if was[i] or now[i]:
                    changes.setdefault(x, set()).add(i)
        sets = list(zip(out, now, strict=True))
    return sorted(sorted(s) for s, _ in sets)


def without_big_components(edges: DataFrame, most: int = 5, a: str = "a", b: str = "b") -> DataFrame:
    """Edges whose component has at most `most` names."""
    parts = connected_components(edges, a, b)
    big = parts.groupBy("component").count().filter(F.col("count") > most).select("component")
    gone = parts.join(big, "component").select(F.col("node").alias(a))
    return edges.join(gone, a, "left_anti")
