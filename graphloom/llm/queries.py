"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, read_table
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.langid import fit_languages, identify_languages
from graphloom.llm.licenses import RARE_WORDS, SHORT, TEMPLATES, scan_licenses
from graphloom.llm.mixing import mix_sources
from graphloom.llm.mtree import top_inner_products
from graphloom.llm.ngram_join import join_components
from graphloom.llm.pii import KINDS, find_personal_data, fit_spans
from graphloom.llm.quality import classify_quality, fit_quality
from graphloom.llm.toxicity import fit_toxicity, score_toxicity
from graphloom.llm.warc import archive_pages


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_languages(docs.filter(~held_out), "text", F.col("lang"), F.col("doc_id"))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    found = classify_quality(docs.select("doc_id", "text", "source", "lang"), model, F.col("source"), F.concat_ws("/", "source", "lang"), keep_text=False)
    return found.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", "keep")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    found = found.withColumn("_base", base)
    starts = F.transform("_base", lambda p: p["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("_base").alias("base_labels"), labels("places").alias("labels"), score.alias("score"))


def _template_rows() -> str:
    listed = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    return ", ".join(f"({i}, '{t.label}', {str(t.base).upper()}, {listed(t.words)}, {listed(t.key_words)}, {t.key_at})" for i, t in enumerate(TEMPLATES))


OP4_SQL = rf"""
WITH t(template, label, base, words, key, key_at) AS (VALUES {_template_rows()}
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), f AS (SELECT word, count(DISTINCT doc_id) AS n FROM u GROUP BY 1
), tw AS (SELECT template, len(words) AS size, unnest(words) AS word, unnest(range(len(words))) AS o FROM t
), r AS (
  SELECT template, word, o FROM tw LEFT JOIN f USING (word)
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 1000000000000), o) <= CASE WHEN size > {SHORT} THEN {RARE_WORDS} ELSE 1 END
), c AS (
  SELECT d.doc_id, d.w, t.*, p - key_at AS s FROM u JOIN t ON u.word = t.key[1] AND p >= key_at JOIN d ON d.doc_id = u.doc_id
  WHERE d.w[p + 1:p + len(key)] = key
), j AS (SELECT c.doc_id, c.template, c.s, count(*) AS rare, count(*) FILTER (c.w[c.s + r.o + 1] = r.word) AS joint FROM c JOIN r USING (template) GROUP BY 1, 2, 3
), found AS (
  SELECT DISTINCT c.doc_id, template, label, base, s, len(list_filter(range(len(words)), lambda i: coalesce(w[s + i + 1] = words[i + 1], false))) / len(words) AS coverage
  FROM c JOIN j USING (template, s) WHERE j.doc_id = c.doc_id AND joint >= (rare + 1) // 2
), a AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM found GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id)
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b AS a, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS k FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(d, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to
FROM bits
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    net = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op9_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_inner_products(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN win USING (k, g)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, fit_spans(docs))
    base = F.filter("pii", lambda s: s["base"])
    counted = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [counted(k) for k in KINDS]
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("_base", base).select("doc_id", *n, F.sha2(digest("_base").cast("binary"), 256).alias("base_sha256"), digest("pii").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing_sources": op1_mixing_sources,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_warc_archives": op6_warc_archives,
    "op7_toxicity": op7_toxicity,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_top_inner_products": op9_top_inner_products,
    "op10_personal_data": op10_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": OP4_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op6_warc_archives": OP6_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op9_top_inner_products": OP9_SQL,
}
