"""Queries from questions to contexts, answers and grades: retrieval, prompts, messages, comparison, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import compare, models, text
from graphloom.operators import evaluate, graph, judges, retrieval
from graphloom.plans.registry import ANSWERS, MUTUAL, STRIP, TREE, answers, key_tree, mutual_graph, neighbours, query, r6
from graphloom.plans.tables import materialize

# --- retrieval --------------------------------------------------------------------------------------------------

TYPES = "['V', 'N', 'O', 'T', 'S', 'A']"
TYPED = f"""
n AS (SELECT vec_id AS node, coalesce({TYPES}[label + 1], 'T') AS type, 'E' || (vec_id % 7) AS name, 'text of ' || vec_id AS content FROM embeddings),
near AS (SELECT src AS qid, dst AS node FROM k WHERE src % 50 = 0 AND rank <= 8)
"""
ENTRY = """
e0 AS (SELECT qid, node FROM near UNION SELECT q.qid, n.node FROM (SELECT DISTINCT src AS qid FROM k WHERE src % 50 = 0) q JOIN n ON n.name = 'E' || (q.qid % 7) AND n.type IN ('N', 'O')
  UNION SELECT near.qid, e.dst FROM near JOIN n v ON v.node = near.node AND v.type = 'V' JOIN edges e ON e.src = near.node JOIN n m ON m.node = e.dst AND m.type = 'N')
"""


def walk(key: str) -> str:
    """SQL of three rounds from e0 (key, node) over edges, and of the cut at a quarter of the mass: table f."""
    step = lambda i: f"r{i} AS (SELECT {key}, dst AS node, sum(0.5 * r * p) AS r FROM r{i - 1} JOIN mv ON src = node GROUP BY ALL)"
    return f"""
d AS (SELECT src, sum(w) AS d FROM edges GROUP BY 1), mv AS (SELECT e.src, e.dst, e.w / d.d AS p FROM edges e JOIN d USING (src)), r0 AS (SELECT {key}, node, 1.0 AS r FROM e0), {step(1)}, {step(2)}, {step(3)},
pi AS (SELECT {key}, node, round(CAST(sum(x) AS DOUBLE), 9) AS pi FROM (SELECT {key}, node, r * 0.5 AS x FROM r0 UNION ALL SELECT {key}, node, r * 0.5 FROM r1 UNION ALL SELECT {key}, node, r * 0.5 FROM r2 UNION ALL SELECT {key}, node, r FROM r3) WHERE ({key}, node) NOT IN (SELECT ({key}, node) FROM e0) GROUP BY ALL),
o AS (SELECT *, coalesce(sum(pi) OVER (PARTITION BY {key} ORDER BY pi DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(pi) OVER (PARTITION BY {key}) AS a, max(pi) OVER (PARTITION BY {key}) AS t FROM pi),
f AS (SELECT {key}, node FROM o WHERE round(b, 9) < round(0.25 * a, 9) OR pi = t UNION SELECT {key}, node FROM e0)
"""


def typed_nodes(t) -> DataFrame:
    kind = F.coalesce(F.get(F.array(*map(F.lit, "VNOTSA")), F.col("label")), F.lit("T"))
    return t("embeddings").select(F.col("vec_id").alias("node_id"), kind.alias("node_type"), F.array(F.concat(F.lit("E"), F.col("vec_id") % 7)).alias("names"), F.concat(F.lit("text of "), "vec_id").alias("content"))


def asked_nodes(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(neighbours, entity seeds, edges, nodes) of the questions, which are every fiftieth vector and ask for one entity each."""
    near, nodes = neighbours(t), typed_nodes(t)
    from graphloom.operators import vectors

    edges = materialize(graph.both_ways(vectors.mutual_edges(near, 0.3).withColumn("w", F.col("sim")), "src", "dst", F.col("w")), "mutual")
    near = near.filter("src % 50 = 0").select(F.col("src").alias("qid"), F.col("dst").alias("node_id"), "rank")
    questions = near.select("qid").distinct().withColumn("entities", F.array(F.concat(F.lit(" e"), F.col("qid") % 7)))
    return near, retrieval.entity_seeds(questions, graph.postings(nodes)), edges, nodes


query("grf18_retrieval_composite", f"WITH {MUTUAL}, {TYPED}, {ENTRY}, {walk('qid')} SELECT qid, node AS node_id, content FROM f JOIN n USING (node) WHERE type NOT IN ('N', 'O')")(lambda t: retrieval.retrieve(*asked_nodes(t)))


@query(
    "grf19_sub_question_contexts",
    f"""WITH {MUTUAL}, {TYPED}, {ENTRY}, {walk('qid')}, q AS (SELECT DISTINCT src AS qid FROM k WHERE src % 50 = 0),
l AS (SELECT q.qid, coalesce(string_agg(node, ',' ORDER BY node) FILTER (type NOT IN ('N', 'O')), '') AS nodes FROM q LEFT JOIN f USING (qid) LEFT JOIN n USING (node) GROUP BY 1)
SELECT qid // 200 AS qid, string_agg(qid % 200 // 50 || ':' || nodes, '|' ORDER BY qid) AS parts FROM l GROUP BY 1""",
)
def _sub_questions(t):
    near, seeds, edges, nodes = asked_nodes(t)
    parted = lambda df: df.withColumns({"sub": F.floor(F.col("qid") % 200 / 50).cast("int"), "qid": F.floor(F.col("qid") / 200)})
    found = retrieval.retrieve_parts(parted(near), parted(seeds), edges, nodes)
    return found.select("qid", F.array_join(F.transform("parts", lambda p: F.concat(p["sub"].cast("string"), F.lit(":"), F.array_join(p["nodes"], ","))), "|").alias("parts"))


REASONED = f"""WITH {TREE}, e0 AS (SELECT 'q' || n_regionkey AS qid, 'N' || n_nationkey AS node FROM nation), {walk('qid')},
x AS (SELECT * FROM f UNION SELECT 'q' || n_regionkey, 'R' || n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) >= 2)
SELECT qid, node AS node_id, 'about ' || node AS content FROM x WHERE node NOT LIKE 'N%'"""


@query("grf18_grf16_retrieval_with_reasoning", REASONED)
def _reasoned(t):
    edges = materialize(key_tree(t), "tree")
    nodes = edges.select(F.col("src").alias("node_id")).distinct().select("node_id", F.left("node_id", F.lit(1)).alias("node_type"), F.concat(F.lit("about "), "node_id").alias("content"))
    entry = t("nation").select(F.concat(F.lit("q"), "n_regionkey").alias("qid"), F.concat(F.lit("N"), "n_nationkey").alias("node_id"))
    return retrieval.retrieve(entry.withColumn("rank", F.lit(1)), entry.limit(0), edges, nodes, reasoning=True)


query("grf15_paths_from_all", f"WITH RECURSIVE {TREE}, l AS (SELECT * FROM edges WHERE left(src, 1) IN ('R', 'N') AND left(dst, 1) IN ('R', 'N')), p AS (SELECT DISTINCT src AS source, src AS node, 0.0::DOUBLE AS dist, [src] AS path FROM l UNION ALL SELECT p.source, l.dst, p.dist + 1 / l.w, list_append(p.path, l.dst) FROM p JOIN l ON l.src = p.node WHERE NOT list_contains(p.path, l.dst)) SELECT source, node AS node_id, round(dist, 6) AS dist, array_to_string(path, '>') AS path FROM p")(
    lambda t: graph.paths_from(key_tree(t).filter(F.left("src", F.lit(1)).isin("R", "N") & F.left("dst", F.lit(1)).isin("R", "N"))).select("source", "node_id", r6("dist").alias("dist"), F.array_join("path", ">").alias("path"))
)
query("top11_rerank_one_question", f"WITH {MUTUAL} SELECT src AS qid, dst AS node_id, CAST(row_number() OVER (ORDER BY sim DESC, rank) AS INTEGER) AS rank FROM k WHERE src = (SELECT src FROM k ORDER BY md5(src || '#7'), src LIMIT 1)")(
    lambda t: (lambda n: retrieval.ranked(n.join(n.select("src").orderBy(F.md5(F.concat(F.col("src").cast("string"), F.lit("#7"))), "src").limit(1), "src", "left_semi").select(F.col("src").alias("qid"), F.col("dst").alias("node_id"), F.col("rank").alias("pos"), F.round("sim", 9).alias("score"))).select("qid", "node_id", "rank"))(neighbours(t))
)

# --- answers in texts -------------------------------------------------------------------------------------------


def answers_in_contexts(wanted: DataFrame, contexts: DataFrame) -> DataFrame:
    """(a_id, c_id) where an answer (a_id, answer) stands in a context (c_id, context) as whole words, whatever the case. An equi-join on the answer's longest word comes first."""
    parts = lambda x: F.filter(F.split(text.upper(x), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")
    asked = wanted.withColumn("w", F.get(F.array_sort(parts("answer"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))), 0))
    words = contexts.select("c_id", F.explode(F.array_distinct(parts("context"))).alias("w"))
    met = words.join(asked.filter("w IS NOT NULL"), "w").select("a_id", "answer", "c_id").distinct()
    found = met.join(contexts, "c_id").filter(text.stands_alone("context", "answer")).select("a_id", "c_id")
    # An answer of signs alone has no word to join on: it meets all contexts.
    bare = asked.filter("w IS NULL AND answer IS NOT NULL").select("a_id", "answer")
    return found.unionByName(contexts.crossJoin(bare).filter(text.stands_alone("context", "answer")).select("a_id", "c_id"))


query("jn18_answer_in_context", "WITH u AS MATERIALIZED (SELECT doc_id, upper(text) AS u FROM documents), b AS MATERIALIZED (SELECT item_id, upper(regexp_replace(text, '[.!? ]+$', '')) AS a FROM benchmark), c AS MATERIALIZED (SELECT item_id, doc_id, a, u FROM b JOIN u ON contains(u, a)) SELECT item_id AS a_id, doc_id AS c_id FROM c WHERE regexp_matches(u, '(^|[^\\pL\\pN_])' || regexp_escape(a) || '($|[^\\pL\\pN_])')")(
    lambda t: answers_in_contexts(t("benchmark").select(F.col("item_id").alias("a_id"), F.regexp_replace("text", "[.!? ]+\\z", "").alias("answer")), t("documents").select(F.col("doc_id").alias("c_id"), F.col("text").alias("context")))
)
query("txt11_plain_answers", "SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '-', ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('and', 'or', 'the', 'of')), ' ') AS plain FROM documents")(lambda t: t("documents").select("doc_id", text.plain_answer("text").alias("plain")))
query("txt5_acronyms", "SELECT c_custkey, c_custkey % 5 <> 3 AS ok FROM customer")(
    lambda t: t("customer").select(
        "c_custkey",
        text.is_acronym(
            F.concat(F.lit("World "), "c_mktsegment", F.lit(" Union")),
            F.get(F.array(F.concat(F.lit("W"), F.left("c_mktsegment", F.lit(1)), F.lit("U")), F.lower(F.concat(F.lit("W."), F.left("c_mktsegment", F.lit(1)), F.lit(".u."))), F.concat(F.lit("WORLD-"), "c_mktsegment", F.lit("_union")), F.lit("WXYU"), F.concat(F.lit("(world) "), "c_mktsegment", F.lit(" union!"))), (F.col("c_custkey") % 5).cast("int")),
        ).alias("ok"),
    )
)
FENCED = f"f AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN ' ```' || text || '``` ' WHEN 2 THEN text || '```' ELSE text END AS x FROM conversations), g AS (SELECT conv_id, turn, {STRIP.format('x')} AS x FROM f)"
query("txt7_txt8_fences", f"WITH {FENCED} SELECT conv_id, turn, {STRIP.format(chr(114) + 'egexp_replace(regexp_replace(x, ' + chr(39) + '^```(json)?' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '```$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS plain, CASE WHEN starts_with(x, '```') THEN {STRIP.format(chr(115) + 'plit_part(x, ' + chr(39) + '```' + chr(39) + ', 2)')} ELSE x END AS block FROM g")(
    lambda t: t("conversations").withColumn("x", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).when(F.col("turn") % 4 == 1, F.concat(F.lit(" ```"), "text", F.lit("``` "))).when(F.col("turn") % 4 == 2, F.concat("text", F.lit("```"))).otherwise(F.col("text"))).select("conv_id", "turn", text.unfenced("x").alias("plain"), text.unfenced_block("x").alias("block"))
)
query("txt19_full_stop", "SELECT p_partkey, p_name || ['.', '.', '!', '?', '»', '%', ').', '5.', '$.'][p_partkey % 9 + 1] AS s FROM part")(
    # Signs that are no punctuation get a full stop, too.
    lambda t: t("part").select("p_partkey", text.with_full_stop(F.concat("p_name", F.get(F.array(*map(F.lit, ("", ".", "!", "? ", "»", "%", ").", "5", "$"))), (F.col("p_partkey") % 9).cast("int")))).alias("s"))
)


@query("txt12_txt14_met7_fuzzy")
def _fuzzy(t):
    return compare.fuzzy_scored(answers(t).select("qid", F.left("answer", F.lit(1 << 30)).alias("answer"), "question"), "answer", "question").select("qid", r6("score").alias("score"), (F.col("score") >= 95).alias("ok"))


query("txt12_met7_contained_answers", f"WITH {ANSWERS} SELECT qid, CAST(100 AS DOUBLE) AS score FROM qa")(
    # The reference is the answer without its first word, and without accents. It isn't cut inside a word: the rest of "hand" would be a word that plain forms leave out.
    lambda t: compare.fuzzy_scored(answers(t).select("qid", "answer", text.plain_answer(F.regexp_replace("answer", "^\\S*\\s+", "")).alias("gold")), "answer", "gold").select("qid", "score")
)

# --- prompts and messages ---------------------------------------------------------------------------------------

PARTS = {"text": "question", "entity": "qid", "units": "question", "relations": "answer", "contexts": "answer", "gold": "answer", "question": "question", "context": "answer", "statements": "qid"}


def _prompt_sql(task: str) -> str:
    import re

    pieces = re.split(r"\{(\w+)\}", models.PROMPTS[task])
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return " || ".join(PARTS[p] if i % 2 else quoted(p) for i, p in enumerate(pieces) if p)


query("txt16_prompts", f"WITH {ANSWERS} " + " UNION ALL ".join(f"SELECT qid, '{task}' AS task, {_prompt_sql(task)} AS prompt FROM qa" for task in models.PROMPTS))(
    lambda t: answers(t).select("qid", F.explode(F.array(*[F.struct(F.lit(task).alias("task"), models.prompt(task, **{k: F.col(v) for k, v in PARTS.items()}).alias("prompt")) for task in models.PROMPTS])).alias("p")).select("qid", "p.*")
)
query(
    "txt17_context_messages",
    f"""WITH {MUTUAL}, c AS (SELECT src AS qid, 'text=---Context ' || rank || '---|' || CASE WHEN label = 0 THEN 'text=This is an image of: L' || label || '|image_url=img' || dst ELSE 'text=node ' || dst END AS part, rank, sim FROM k JOIN embeddings ON vec_id = dst WHERE rank <= 8)
SELECT vec_id AS qid, 'text=[CONTEXT]|' || coalesce((SELECT string_agg(part, '|' ORDER BY rank) || '|' FROM c WHERE c.qid = vec_id AND sim >= 0.3), '') || 'text=[QUESTION]' || chr(10) || 'about ' || vec_id || '|text=[QUESTION IMAGE]|image_url=q' || vec_id || '|text=[QUESTION]' || chr(10) || 'about ' || vec_id AS message FROM embeddings""",
)(
    lambda t: neighbours(t).filter("rank <= 8").join(t("embeddings").select(F.col("vec_id").alias("dst"), "label"), "dst")
    .select("src", F.struct("rank", F.round("sim", 9).alias("score"), F.when(F.col("label") == 0, "V").otherwise("T").alias("type"), F.when(F.col("label") == 0, F.concat(F.lit("img"), "dst")).otherwise(F.concat(F.lit("node "), "dst")).alias("content"), F.concat(F.lit("L"), "label").alias("names")).alias("c"))
    .groupBy(F.col("src").alias("qid")).agg(F.collect_list("c").alias("contexts"))
    .select("qid", text.message_text(text.context_messages("contexts", F.concat(F.lit("about "), "qid"), F.concat(F.lit("q"), "qid"), 0.3)).alias("message"))
)
query("txt22_embedding_messages", f"WITH {ANSWERS}, x AS (SELECT qid, length(answer) % 5 AS m, question FROM qa) SELECT qid, 'text=Represent the input.|' || CASE WHEN m = 4 THEN 'text=NULL' ELSE concat_ws('|', CASE WHEN m IN (0, 1) THEN 'video=v.mp4' END, CASE WHEN m IN (0, 2) THEN 'image_url=i.png' END, CASE WHEN m IN (0, 3, 2) THEN 'text=' || question END) END AS message FROM x")(
    lambda t: (lambda m: answers(t).select("qid", text.message_text(text.embedding_message(F.lit("Represent the input"), F.when(m.isin(0, 2, 3), F.col("question")).otherwise(""), F.when(m.isin(0, 2), "i.png"), F.when(m.isin(0, 1), "v.mp4"))).alias("message")))(F.length("answer") % 5)
)

# --- models and judges ------------------------------------------------------------------------------------------

NAMES = "(SELECT id, e, min(pos) AS pos FROM (SELECT id, unnest(regexp_extract_all(x, '[A-Z][a-z]+')) AS e, unnest(range(len(regexp_extract_all(x, '[A-Z][a-z]+')))) AS pos FROM asked) GROUP BY 1, 2)"
query("udf8_sub_questions", f"WITH asked AS (SELECT conv_id || '-' || turn AS id, text AS x FROM conversations WHERE role = 'user') SELECT id, 'What is ' || e || '?' AS question FROM {NAMES} QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 4")(
    lambda t: models.answered(t("conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("asked")), F.col("asked"), lambda: models.stand_in_questions).select("id", F.explode(text.string_list("text")).alias("question"))
)


def described(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, said): what a model is told of S, A, H, T and V nodes: their content, or of an image the names of the last entity that it is linked with."""
    named = nodes.filter("node_type = 'N'").select(F.col("node_id").alias("dst"), "content")
    last = edges.join(named, "dst").groupBy("src").agg(F.max_by("content", "dst").alias("names"))
    told = nodes.filter(F.col("node_type").isin("S", "A", "H", "T", "V")).join(last.withColumnRenamed("src", "node_id"), "node_id", "left")
    return told.select("node_id", F.when(F.col("node_type") == "V", F.concat(F.lit("This image contains: "), F.coalesce("names", F.lit("")))).otherwise(F.col("content")).alias("said"))


HYPOTHETICAL = models.PROMPTS["hypothetical"].split("{text}")[0].replace("\n", "' || chr(10) || '")


@query("udf9_hypothetical_questions", f"WITH last AS (SELECT src, arg_max('Entity Number ' || (dst % 13), dst) AS names FROM edges JOIN embeddings ON vec_id = dst WHERE label = 1 GROUP BY 1), asked AS (SELECT vec_id AS id, '{HYPOTHETICAL}' || CASE WHEN label = 0 THEN 'This image contains: ' || coalesce(names, '') ELSE 'Ab Cd Ef Gh Ij Kl Mn Op Qr St Uv ' || upper(chr(97 + label)) || 'x' END AS x FROM embeddings LEFT JOIN last ON src = vec_id WHERE label NOT IN (1, 2)) SELECT id, 'What is ' || e || '?' AS question FROM {NAMES} QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 10".replace("WITH last", f"WITH {MUTUAL}, last"))
def _hypothetical(t):
    told = F.when(F.col("node_type") == "N", F.concat(F.lit("Entity Number "), F.col("node_id") % 13)).otherwise(F.concat(F.lit("Ab Cd Ef Gh Ij Kl Mn Op Qr St Uv "), F.upper(F.char(97 + F.col("label"))), F.lit("x")))
    nodes = typed_nodes(t).drop("content", "names").join(t("embeddings").select(F.col("vec_id").alias("node_id"), "label"), "node_id").withColumn("content", told)
    rows = described(nodes, mutual_graph(t)).withColumnRenamed("node_id", "id")
    return models.answered(rows, models.prompt("hypothetical", text=F.col("said")), lambda: models.stand_in_hypothetical).select("id", F.explode(text.string_list("text")).alias("question"))


query("udf5_udf10_summaries", "SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:20], ' ') AS summary, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM conversations")(
    lambda t: models.answered(t("conversations").select("conv_id", "turn", F.col("text").alias("asked")), F.col("asked"), lambda: models.stand_in_summary).select("conv_id", "turn", F.col("text").alias("summary"), "tokens")
)
SAID = "list_filter(list_transform(regexp_extract_all({}, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
# What is judged: an answer, of which the context has the first half and the reference the second one and the question.
JUDGED = f"{ANSWERS}, j AS (SELECT qid, question, answer, left(answer, length(answer) // 2) AS context, right(answer, length(answer) - length(answer) // 2) || ' ' || question AS gold, length(answer) % 3 AS m FROM qa), b AS (SELECT qid, question, CASE WHEN m = 0 THEN ' ' ELSE answer END AS answer, CASE WHEN m = 1 THEN '' ELSE context END AS context, gold FROM j)"


def judged_rows(t, blanks: bool = True) -> DataFrame:
    rows = answers(t).select("qid", "question", "answer", F.length("answer").alias("n")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    gold = F.concat(F.right("answer", F.col("n") - F.col("half")), F.lit(" "), "question")
    rows = rows.select("qid", "question", "answer", F.left("answer", F.col("half")).alias("context"), gold.alias("gold"), (F.col("n") % 3).alias("m"))
    if not blanks:
        return rows.drop("m")
    return rows.withColumns({"answer": F.when(F.col("m") == 0, " ").otherwise(F.col("answer")), "context": F.when(F.col("m") == 1, "").otherwise(F.col("context"))}).drop("m")


def _shared(said: str, context: str) -> str:
    held = f"list_filter({said}, lambda s: contains(lower({context}), lower(s)))"
    return f"len({held}) / len({said})"


query("udf14_met2_judged_accuracy", f"WITH {JUDGED}, s AS (SELECT qid, {SAID.format('answer')} AS mine, {SAID.format('gold')} AS theirs FROM j), c AS (SELECT qid, len(list_filter(mine, lambda x: list_contains(theirs, x))) AS tp, len(list_filter(mine, lambda x: NOT list_contains(theirs, x))) AS fp, len(list_filter(theirs, lambda x: NOT list_contains(mine, x))) AS fn FROM s), f AS (SELECT *, tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS r FROM c) SELECT qid, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, round(0.75 * (2 * p * r / (p + r + 1e-10)) + 0.25 * 0.5, 6) AS accuracy FROM f")(
    lambda t: judges.judged_accuracy(judged_rows(t, False), F.lit(0.5)).withColumn("accuracy", r6("accuracy"))
)
query("udf14_met3_judged_recall", f"WITH {JUDGED} SELECT qid, CASE WHEN {STRIP.format('context')} = '' THEN 0 ELSE CAST(len(list_filter({SAID.format('gold')}, lambda s: contains(lower(context), lower(s)))) > 0 AS INTEGER) END AS context_recall FROM b")(lambda t: judges.judged_recall(judged_rows(t)))
query("udf14_met5_judged_coverage", f"WITH {JUDGED} SELECT qid, round({_shared(SAID.format('gold'), 'answer')}, 6) AS coverage FROM j")(lambda t: judges.judged_coverage(judged_rows(t, False).withColumn("context", F.col("answer"))).withColumn("coverage", r6("coverage")))
query("udf14_met6_judged_faithfulness", f"WITH {JUDGED} SELECT qid, CASE WHEN {STRIP.format('answer')} = '' THEN 1.0 WHEN {STRIP.format('context')} = '' THEN 0.0 ELSE round({_shared(SAID.format('answer'), 'context')}, 6) END::DOUBLE AS faithfulness FROM b")(lambda t: judges.judged_faithfulness(judged_rows(t)).withColumn("faithfulness", r6("faithfulness")))
WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^0-9a-z]+'), lambda w: w <> ''))"
query("udf14_met4_judged_relevance", f"WITH {JUDGED}, w AS (SELECT qid, context, {WORDS.format('question')} AS q, {WORDS.format('context')} AS c FROM b) SELECT qid, CASE WHEN {STRIP.format('context')} = '' THEN 0.0 WHEN len(list_intersect(q, c)) = len(q) THEN 1.0 WHEN len(list_intersect(q, c)) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS relevance FROM w")(lambda t: judges.judged_relevance(judged_rows(t)))


@query("met9_udf11_graded_answers", f"WITH {ANSWERS}, g AS (SELECT qid, length(answer) % 4 AS m, question, answer FROM qa) SELECT qid, CASE WHEN m = 0 THEN 1 WHEN m = 1 THEN 1 ELSE 0 END AS score, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS asked FROM g")
def _graded(t):
    m: Column = F.length("answer") % 4
    # The judge's answer is right where the reference ends with a line that the answer repeats.
    rows = answers(t).select("qid", F.when(m == 0, 100.0).otherwise(10.0).alias("fuzzy"), F.concat(F.lit("reference\n"), F.when(m == 1, "yes, this").otherwise("no")).alias("gold"), F.lit("yes").alias("answer"))
    return judges.graded(rows, "fuzzy")


query("met3_context_recall", "SELECT o_orderkey AS qid, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS INT) END AS context_recall FROM orders")(
    lambda t: evaluate.context_recall(t("lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_returnflag") == "R").cast("int").alias("verdict")), t("orders").select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderstatus") == "F", " ").otherwise("a").alias("answer"), F.when(F.col("o_orderstatus") == "O", "").otherwise("c").alias("context")))
)
query("met4_context_relevance", "SELECT l_orderkey || '-' || l_linenumber AS qid, CASE WHEN l_linenumber = 4 THEN 0 ELSE (least(l_linenumber, 2) / 2 + 0.5) / 2 END AS relevance FROM lineitem")(
    lambda t: evaluate.context_relevance(t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qid"), F.least("l_linenumber", F.lit(2)).alias("r1"), F.lit(1).alias("r2"), F.when(F.col("l_linenumber") == 4, "q").otherwise("c").alias("context"), F.lit("q").alias("question")))
)
