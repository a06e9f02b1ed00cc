"""Queries of entity resolution, graph builders, groups and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import models, text
from graphloom.operators import graph, resolution, retrieval, vectors
from graphloom.operators.components import connected_components
from graphloom.plans.registry import MUTUAL, TREE, UNITS, key_tree, mentions, mutual_graph, named_units, neighbours, query, r6
from graphloom.plans.tables import materialize

MUTUAL_PARTS = "h AS (SELECT src, dst FROM m WHERE sim > 0.42), e AS (SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h), r AS (SELECT src AS node, src AS c FROM e UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.node), p AS (SELECT node, min(c) AS c FROM r GROUP BY 1), z AS (SELECT c, count(*) AS n FROM p GROUP BY 1)"


def close_pairs(t, least: float) -> DataFrame:
    return vectors.mutual_edges(neighbours(t), 0.3).filter(F.round("sim", 9) > least).select(F.col("src").alias("a"), F.col("dst").alias("b"))


# --- resolution -------------------------------------------------------------------------------------------------

NAME = "CASE vec_id % 3 WHEN 0 THEN 'North Sea Union ' || chr(65 + label) || ' ' || vec_id // 30 WHEN 1 THEN 'NSU' || chr(65 + label) || vec_id // 30 ELSE 'Unit ' || vec_id END"


def named_vectors(t) -> DataFrame:
    """Names for vectors: some in full, some by their initials."""
    letter, place = F.char(65 + F.col("label")), F.floor(F.col("vec_id") / 30)
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("North Sea Union "), letter, F.lit(" "), place)).when(F.col("vec_id") % 3 == 1, F.concat(F.lit("NSU"), letter, place)).otherwise(F.concat(F.lit("Unit "), "vec_id"))
    return t("embeddings").select(name.alias("name"), "vec_id", "embedding").groupBy("name").agg(F.min_by("embedding", "vec_id").alias("embedding"))


NAMED = f"""
v AS (SELECT name, arg_min(embedding, vec_id) AS x FROM (SELECT {NAME} AS name, vec_id, embedding FROM embeddings) GROUP BY 1),
s AS (SELECT a.name AS a, b.name AS b, round(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])), 9) AS sim FROM v a JOIN v b ON a.name <> b.name),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 50),
n AS (SELECT name, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS plain, array_to_string(list_transform(regexp_extract_all(upper(name), '[A-Z]+'), lambda w: w[1]), '') AS initials FROM v)
"""
query("vec6_similar_or_acronym", f"WITH {NAMED} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k JOIN n x ON x.name = a JOIN n y ON y.name = b WHERE sim >= 0.45 OR (length(x.plain) >= 2 AND length(y.plain) >= 2 AND (x.plain = y.plain OR x.plain = y.initials OR y.plain = x.initials))")(
    lambda t: resolution.similar_names(named_vectors(t), 50, 0.45)
)
query("grf9_without_big_components", f"WITH RECURSIVE {MUTUAL}, {MUTUAL_PARTS} SELECT src AS a, dst AS b FROM h JOIN p ON p.node = src JOIN z USING (c) WHERE n <= 5")(lambda t: graph.without_big_components(close_pairs(t, 0.42)).select("a", "b"))
query(
    "grf7_grf8_cliques",
    f"""WITH RECURSIVE {MUTUAL}, h AS (SELECT src, dst FROM m WHERE sim > 0.4), e AS (SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h), adj AS (SELECT src AS n, list(dst) AS near FROM e GROUP BY 1),
c AS (SELECT [n] AS names, near FROM adj UNION ALL SELECT list_append(c.names, adj.n), list_intersect(c.near, adj.near) FROM c JOIN adj ON list_contains(c.near, adj.n) AND adj.n > c.names[-1])
SELECT array_to_string(names, ',') AS clique FROM c WHERE len(near) = 0""",
)(lambda t: graph.maximal_cliques(close_pairs(t, 0.4)).select(F.array_join("clique", ",").alias("clique")))


@query("grf9_udf4_resolved_entities")
def _resolved(t):
    edges = close_pairs(t, 0.36).select(*[F.concat(F.lit("E"), F.col(c) % 5, F.lit(" "), c).alias(c) for c in ("a", "b")])
    return resolution.resolve(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), lambda: models.stand_in_match)


GROUPED = "SELECT doc_id, array_to_string(list_transform(list_sort(list(g)), lambda x: x.names), '|') AS groups FROM (SELECT doc_id, struct_pack(l := left(e, 1), names := string_agg(e, ',' ORDER BY e)) AS g FROM x GROUP BY doc_id, left(e, 1)) GROUP BY 1"
query("udf4_val5_matched_names", f"WITH {UNITS}, x AS (SELECT DISTINCT doc_id, upper(e) AS e FROM mentions) {GROUPED}")(
    lambda t: resolution.matched(mentions(t).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.upper("e"))).alias("names")), lambda: models.stand_in_match).select("doc_id", F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), "|").alias("groups"))
)


@query("set6_merged_groups")
def _merged(t):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("S"), "l_suppkey")).alias("clique"))
    lists = lists.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "clique")
    merged = resolution.merged_groups(lists, "o_custkey", 12)
    return merged.select("o_custkey", F.array_join("names", ",").alias("names"))


query("agg7_group_sizes", f"WITH RECURSIVE {MUTUAL}, {MUTUAL_PARTS} SELECT max(n) AS most, round(avg(n), 6) AS mean FROM z")(
    lambda t: connected_components(close_pairs(t, 0.42), "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))
)

# --- builders ---------------------------------------------------------------------------------------------------


def _nation_nodes(t) -> DataFrame:
    return t("nation").select(F.concat(F.lit("N"), F.format_string("%06d", "n_nationkey")).alias("node_id"), F.lit("N").alias("node_type"), F.col("n_name").alias("content"))


def _attributes(t) -> tuple[DataFrame, DataFrame]:
    told = t("nation").select(F.concat(F.lit("N"), F.format_string("%06d", "n_nationkey")).alias("entity_id"), F.concat(F.lit("About "), "n_name").alias("summary"))
    return graph.attribute_nodes(_nation_nodes(t), told)


SIX = "lpad(CAST({} AS VARCHAR), 6, '0')"
query("grf3_val7_attribute_nodes", f"SELECT 'N' || {SIX.format('n_nationkey')} || ':A000' AS node_id, 'A' AS node_type, 'About ' || n_name AS content, 'N' || {SIX.format('n_nationkey')} AS source FROM nation")(lambda t: _attributes(t)[0])
query("grf3_attribute_edges", f"WITH x AS (SELECT 'N' || {SIX.format('n_nationkey')} AS n FROM nation) SELECT n AS src, n || ':A000' AS dst, 1.0::DOUBLE AS w FROM x UNION ALL SELECT n || ':A000', n, 1.0::DOUBLE FROM x")(lambda t: _attributes(t)[1])

TURNS = f"""
t AS (SELECT conv_id || ':' || turn AS node, CASE WHEN turn % 5 = 3 THEN 'R' WHEN role = 'user' THEN 'T' ELSE 'S' END AS type, text, 'H' || {SIX.format('conv_id % 40')} AS h, CAST(turn % 4 AS INTEGER) AS cluster, conv_id FROM conversations),
told AS (SELECT h, count(*) AS n, string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY node) AS i FROM t WHERE type <> 'R') GROUP BY 1 HAVING count(*) >= 3)
"""


def _turns(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of conversations as nodes (node_id, node_type, content), members of communities (h, node) and clusters (node, cluster)."""
    c = t("conversations").withColumn("node_id", F.concat_ws(":", "conv_id", "turn"))
    kind = F.when(F.col("turn") % 5 == 3, "R").when(F.col("role") == "user", "T").otherwise("S")
    return (
        c.select("node_id", kind.alias("node_type"), F.col("text").alias("content")),
        c.select(text.serial_id("H", (F.col("conv_id") % 40)).alias("h"), F.col("node_id").alias("node")),
        c.select(F.col("node_id").alias("node"), (F.col("turn") % 4).cast("int").alias("cluster")),
    )


query("flt5_agg12_community_texts", f"WITH {TURNS} SELECT h, texts FROM told")(lambda t: graph.community_texts(*_turns(t)[:2]))


def community_summaries(t) -> DataFrame:
    """(h, summary, overview): by the stand-ins of the models."""
    told = materialize(graph.community_texts(*_turns(t)[:2]), "community-texts")
    summed = models.answered(told, models.prompt("community", text=F.col("texts")), lambda: models.stand_in_summary, models.Retry(attempts=30, failure="raise"), valid=lambda s: bool(s.strip()))
    summed = summed.select("h", F.col("text").alias("summary"))
    listed = models.answered(summed, models.prompt("overview", text=F.regexp_replace("summary", "\\s+", " ")), lambda: models.stand_in_keywords)
    return listed.select("h", "summary", text.string_list(text.unfenced("text")).alias("overview")).filter(text.nonblank_list("overview", 3, 50))


SUMMED = f"""{TURNS},
summed AS (SELECT h, array_to_string(list_filter(string_split_regex('Summarise these passages in one paragraph.' || chr(10) || texts, '\\s+'), lambda w: w <> '')[1:20], ' ') AS summary FROM told),
kw AS (SELECT h, w, min(i) AS i FROM (SELECT h, unnest(regexp_extract_all(summary, '[A-Za-z0-9]+')) AS w, unnest(range(len(regexp_extract_all(summary, '[A-Za-z0-9]+')))) AS i FROM summed) GROUP BY 1, 2)
"""
query("udf6_val4_grf4_community_nodes", f"WITH {SUMMED}, o AS (SELECT h, string_agg(w, ', ' ORDER BY i) AS l, count(*) AS n FROM kw GROUP BY 1 HAVING count(*) BETWEEN 3 AND 50) SELECT h AS node_id, 'H' AS node_type, summary AS content FROM summed JOIN o USING (h) UNION ALL SELECT h || ':O000', 'O', l FROM o")(
    lambda t: (lambda n, m, c: graph.community_nodes(community_summaries(t), m, c, _h_clusters(t))[0].select("node_id", "node_type", "content"))(*_turns(t))
)


def _h_clusters(t) -> DataFrame:
    """(h, cluster): three clusters a community."""
    h = t("conversations").select((F.col("conv_id") % 40).alias("k")).distinct()
    return h.select(text.serial_id("H", "k").alias("h"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((F.col("k") + i) % 4).cast("int"))).alias("cluster"))


query("jn12_set4_grf4_community_edges", f"WITH {TURNS}, l AS (SELECT DISTINCT h, node FROM t JOIN told USING (h) WHERE list_contains([(conv_id % 40) % 4, (conv_id % 40 + 1) % 4, (conv_id % 40 + 2) % 4], cluster)), x AS (SELECT h AS a, node AS b FROM l UNION ALL SELECT h, h || ':O000' FROM told) SELECT a AS src, b AS dst, 1.0::DOUBLE AS w FROM x UNION ALL SELECT b, a, 1.0::DOUBLE FROM x")(
    lambda t: (lambda n, m, c: graph.community_nodes(graph.community_texts(n, m).select("h", F.col("texts").alias("summary"), F.array("h").alias("overview")), m, c, _h_clusters(t))[1])(*_turns(t))
)
query("agg4_degree_stats", f"WITH {TREE}, d AS (SELECT src, sum(w) AS d FROM edges GROUP BY 1) SELECT min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS avg_degree, (SELECT count(*) FROM part) AS isolated, (SELECT min(w) FROM edges) AS min_weight, (SELECT max(w) FROM edges) AS max_weight FROM (SELECT d FROM d UNION ALL SELECT 0 FROM part)")(
    # Parts are nodes that no edge has.
    lambda t: (lambda e: graph.degree_stats(e.select(F.col("src").alias("node_id")).distinct().unionByName(t("part").select(F.concat(F.lit("P"), "p_partkey").alias("node_id"))), e))(key_tree(t))
)
query("agg5_flt11_degrees_of_a_type", f"WITH {TREE}, d AS (SELECT src, sum(w) AS d FROM edges GROUP BY 1) SELECT contains(src, 'N') AS n, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean, count(*) AS nodes FROM d WHERE NOT contains(src, 'S') AND NOT contains(src, 'C') GROUP BY 1")(
    lambda t: graph.degrees(key_tree(t)).filter(~F.col("node_id").contains("S") & ~F.col("node_id").contains("C")).groupBy(F.col("node_id").contains("N").alias("n")).agg(F.min("degree").alias("least"), F.max("degree").alias("most"), r6(F.avg("degree")).alias("mean"), F.count(F.lit(1)).alias("nodes"))
)
query("grf10_communities")(lambda t: graph.communities(mutual_graph(t)))
query("grf10_spread_labels")(lambda t: graph.spread_labels(mutual_graph(t)))
query("jn13_inverted_lookup", f"WITH {UNITS}, ix AS (SELECT DISTINCT upper(e) AS e, doc_id FROM mentions), qs AS (SELECT conv_id || '-' || turn AS qid, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS e FROM conversations WHERE role = 'user') SELECT DISTINCT qid, doc_id AS node_id FROM qs JOIN ix ON upper(qs.e) = ix.e")(
    lambda t: retrieval.entity_seeds(
        t("conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("entities")),
        graph.postings(mentions(t).select(F.col("doc_id").alias("node_id"), F.lit("N").alias("node_type"), F.array(text.entity_key("e")).alias("names"))),
    )
)
query("agg19_units_with_most_entities", f"WITH {UNITS} SELECT doc_id, max(len(regexp_extract_all(u, '[A-Z][a-z]+'))) AS most FROM units GROUP BY 1")(lambda t: named_units(t).groupBy("doc_id").agg(F.max(F.size("entities")).cast("long").alias("most")))

# --- vectors ----------------------------------------------------------------------------------------------------

query("vec3_exact_neighbours", f"WITH {MUTUAL} SELECT src, dst, round(raw, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM k")(lambda t: neighbours(t).withColumn("sim", r6("sim")))


@query("vec4_probed_neighbours")
def _probed(t):
    e = t("embeddings")
    return vectors.probed_top_k(e.select(F.col("vec_id").alias("src"), "embedding"), e.select(F.col("vec_id").alias("dst"), "embedding"), 16, "src", "dst", drop_self=True, probes=16).withColumn("sim", r6("sim"))


ORDERED = "s AS (SELECT a.vec_id AS qid, b.vec_id // 3 AS node_id, CAST(b.vec_id % 3 AS INTEGER) AS ord, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS raw, round(raw, 9) AS sim FROM embeddings a, embeddings b), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, node_id, ord) AS n FROM s)"


def _node_vectors(t) -> DataFrame:
    return t("embeddings").select(F.floor(F.col("vec_id") / 3).alias("node_id"), (F.col("vec_id") % 3).cast("int").alias("ord"), "embedding")


query("vec5_many_vectors_a_node", f"WITH {ORDERED} SELECT qid, node_id, ord, round(raw, 6) AS sim, CAST(n AS INTEGER) AS rank FROM o WHERE n <= 8")(lambda t: vectors.node_top_k(t("embeddings").withColumnRenamed("vec_id", "qid"), _node_vectors(t), 8).withColumn("sim", r6("sim")))
query("vec5_best_vector_a_node", f"WITH {ORDERED}, f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY qid, node_id ORDER BY n) = 1), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS r FROM f) SELECT qid, node_id, ord, round(raw, 6) AS sim, CAST(r AS INTEGER) AS rank FROM g WHERE r <= 8")(
    lambda t: vectors.node_top_k(t("embeddings").withColumnRenamed("vec_id", "qid"), _node_vectors(t), 8, fold=True).withColumn("sim", r6("sim"))
)
query("vec8_spherical_kmeans")(lambda t: vectors.spherical_kmeans(t("embeddings"), "vec_id")[0])


def _label_centres(t) -> DataFrame:
    """(cluster, centre): the sums of each label's vectors, in steps of a thousandth."""
    parts = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.round(F.col("x").cast("double") * 1000).cast("long")).alias("x"))
    return parts.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"] / 1000.0).alias("centre"))


query(
    "vec9_nearest_centres",
    """WITH x AS (SELECT label, i, sum(CAST(round(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT)) / 1000 AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label AS cluster, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM x GROUP BY 1),
s AS (SELECT vec_id, cluster, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 9) AS sim FROM embeddings, c)
SELECT vec_id, cluster, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster) <= 3""",
)(lambda t: vectors.nearest_centres(t("embeddings"), _label_centres(t), 3, "vec_id"))


@query("vec9_vec10_clusters_of_both_kinds", "SELECT CASE WHEN vec_id % 9 = 0 THEN 'H' || lpad(CAST(vec_id AS VARCHAR), 6, '0') ELSE 'HT' || vec_id END AS id, CASE WHEN vec_id % 9 = 0 THEN 3 ELSE 1 END AS clusters FROM embeddings")
def _both_kinds(t):
    rows = t("embeddings").select(F.when(F.col("vec_id") % 9 == 0, text.serial_id("H", "vec_id")).otherwise(F.concat(F.lit("HT"), "vec_id")).alias("id"), "embedding")
    low, high = vectors.in_clusters(rows, "^H[0-9]+$")
    return low.unionByName(high).groupBy("id").agg(F.countDistinct("cluster").cast("int").alias("clusters"))
