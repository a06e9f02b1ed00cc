"""Queries over folders, files, copies and checks of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, sampling
from graphloom.plans.registry import MUTUAL, neighbours, query
from graphloom.plans.tables import materialize, shared_dir
from graphloom.sources import files

EXTENSIONS = ("jpg", "JPEG", "png", "txt", "webp", "bmp", "gif")
PLACES = 21
"""Files of the fixture: three shards times seven endings."""
FILES = f"f AS (SELECT m, 'img' || m AS id, m % 3 + 1 AS shard, lower({list(EXTENSIONS)}[m % 7 + 1]) AS ext, n FROM (SELECT page_id % {PLACES} AS m, count(*) AS n FROM pages GROUP BY 1)), i AS (SELECT * FROM f WHERE ext <> 'txt')"


def _folder(t, name: str) -> str:
    return f"{shared_dir(t('pages').sparkSession)}/{name}-{uuid.uuid4().hex}"


def image_folder(t) -> str:
    """A folder of small files in shards: one for every remainder of the pages' ids, which holds how many pages have it."""
    pages, root = t("pages"), _folder(t, "images")
    for r in pages.groupBy((F.col("page_id") % PLACES).alias("m")).count().collect():
        files.write_file(pages.sparkSession, f"{root}/{r['m'] % 3 + 1:02d}/img{r['m']}.{EXTENSIONS[r['m'] % 7]}", str(r["count"]).encode())
    return root


@query("src4_src5_src6_image_folders", f"WITH {FILES} SELECT 'flat' AS kind, id, ext, n AS pages FROM i WHERE shard = 1 UNION ALL SELECT 'recursive', id, ext, n FROM i UNION ALL SELECT 'shards', id, ext, n FROM i WHERE shard > 1")
def _image_folders(t):
    spark, root = t("pages").sparkSession, image_folder(t)
    kinds = {"flat": files.read_images(spark, f"{root}/01"), "recursive": files.read_images(spark, root, recursive=True), "shards": files.read_images(spark, *(f"{root}/{k:02d}" for k in range(2, 100)))}
    rows = [df.select(F.lit(kind).alias("kind"), "id", "ext", F.col("content").cast("string").cast("long").alias("pages")) for kind, df in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("snk4_snk5_copied_images", f"WITH {FILES} SELECT id, ext, (SELECT count(*) FROM i WHERE ext IN ('jpg', 'png')) AS copies FROM i WHERE ext IN ('jpg', 'png')")
def _copied_images(t):
    spark, target = t("pages").sparkSession, _folder(t, "copies")
    images = files.read_images(spark, image_folder(t), recursive=True)
    files.write_file(spark, f"{target}/stale.jpg", b"to be wiped")
    copied = files.copy_images(images.filter(F.col("ext").isin("jpg", "png")), target)
    named = lambda df: df.select(files.file_name("path").alias("path"))
    return copied.select("id", "ext").join(files.checked_copies(named(copied), named(images)).withColumnRenamed("n", "copies"), F.lit(True))


@query("val10_missing_images", f"SELECT 'img' || m AS id FROM (SELECT DISTINCT page_id % {PLACES} AS m FROM pages) WHERE m % 7 = 3")
def _missing_images(t):
    there = files.read_images(t("pages").sparkSession, image_folder(t), recursive=True)
    named = t("pages").select(F.concat(F.lit("img"), F.col("page_id") % PLACES).alias("id")).distinct()
    return named.join(there.select("id"), "id", "left_anti")


@query("snk2_ascii_jsonl", "SELECT doc_id, text, true AS plain FROM documents")
def _ascii_jsonl(t):
    rows, path = t("documents").select("doc_id", "text"), _folder(t, "ascii")
    files.write_jsonl(rows, path, ascii_only=True)
    lines = rows.sparkSession.read.text(path)
    return files.read_jsonl(rows.sparkSession, path, rows.schema).join(lines.agg(F.bool_and(~F.col("value").rlike("[^\\x00-\\x7F]")).alias("plain")), F.lit(True))


@query("snk6_text_blocks", "SELECT value, count(*) AS n FROM (SELECT unnest(['Context ' || page_id || ':', url, '']) AS value FROM pages) GROUP BY 1")
def _text_blocks(t):
    path = _folder(t, "blocks")
    files.write_blocks(t("pages").select(F.col("page_id").alias("rank"), F.col("url").alias("content")), path)
    return t("pages").sparkSession.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("ckp2_paired_prefix", "SELECT pos, page_id AS id, label FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS pos FROM pages) JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) USING (pos)")
def _paired_prefix(t):
    ids = graph.numbered_rows(t("pages").select(F.col("page_id").alias("id")), ["id"], "pos")
    vectors = graph.numbered_rows(t("embeddings").select("vec_id", "label"), ["vec_id"], "pos").select("pos", "label")
    return files.paired_prefix(ids, vectors).withColumn("pos", F.col("pos").cast("long"))


@query("ckp7_resume_checked", "SELECT vec_id FROM embeddings WHERE label <> 3")
def _resume_checked(t):
    done = t("embeddings").filter("label = 3").select("vec_id", F.lit("N").alias("node_type"))
    return files.not_done(t("embeddings").select("vec_id"), files.checked_done(done, "vec_id", "node_type", "N"), "vec_id")


@query("val11_val15_val16_typed_rows", "SELECT label % 5 = 0 AS bad, count(*) AS n FROM embeddings GROUP BY 1")
def _typed_rows(t):
    rows, path = t("embeddings"), _folder(t, "typed")
    rows.select(F.when(F.col("label") % 5 == 0, F.lit('{"vec_id": "not a number", "label": [1]}')).otherwise(F.to_json(F.struct("vec_id", "label"))).alias("value")).write.text(path)
    read = materialize(files.read_jsonl(rows.sparkSession, path, "vec_id long, label int", strict=False), "typed")
    return read.groupBy(F.col(files.CORRUPT).isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"))


query("val12_context_sizes", f"WITH {MUTUAL} SELECT src AS qid, count(*) AS n FROM k WHERE rank <= 8 AND sim > 0.35 GROUP BY 1 HAVING count(*) <> 8")(
    lambda t: neighbours(t).filter((F.col("rank") <= 8) & (F.round("sim", 9) > 0.35)).groupBy(F.col("src").alias("qid")).agg(F.count(F.lit(1)).alias("n")).filter("n <> 8")
)
query("val13_question_images", "SELECT page_id, CAST(page_id AS VARCHAR) AS image_id FROM pages")(lambda t: files.question_images(t("pages").select("page_id", F.concat("page_id", F.lit(".JPEG")).alias("file")), "file").select("page_id", "image_id"))
query("txt20_image_urls", "SELECT page_id, page_id % 8 IN (0, 1, 2, 5) AS image FROM pages")(
    lambda t: t("pages").select(
        "page_id",
        text.is_image_url(
            F.concat(
                F.when(F.col("page_id") % 8 == 7, "images/").otherwise("https://host/"),
                F.col("page_id").cast("string"),
                F.get(F.array(*map(F.lit, ("/a.png?x=1", "/a.TIFF", "/a.svg#f", "/.jpg", "/a.jpg.txt", "/a.jpeg;v=2", "/a?f=.png", ".gif?x"))), (F.col("page_id") % 8).cast("int")),
            )
        ).alias("image"),
    )
)
query("txt24_video_inputs", "SELECT page_id, page_id % 5 IN (0, 1, 2) AS video FROM pages")(
    lambda t: t("pages").select(
        "page_id",
        text.is_video(
            F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("clips/"), "page_id")),
            F.when(F.col("page_id") % 5 == 1, F.array(F.concat(F.lit("frames/"), "page_id", F.lit(".PNG")), F.lit("notes.txt")))
            .when(F.col("page_id") % 5 == 2, F.array(F.lit("https://host/f.webp?at=1")))
            .when(F.col("page_id") % 5 == 3, F.array(F.lit("notes.txt"), F.lit("f.png")))
            .when(F.col("page_id") % 5 == 4, F.array().cast("array<string>")),
        ).alias("video"),
    )
)
query("jn10_jn11_jn15_node_content", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda t: files.required(t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t("customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")
)
query("top1_global_sample", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '#7'), doc_id LIMIT 100")(lambda t: sampling.sample_rows(t("documents").select("doc_id", "source"), "doc_id", 100))
query("top2_sample_a_group", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '#7'), doc_id) <= 2")(lambda t: sampling.sample_a_group(t("documents").select("doc_id", "source"), "source", "doc_id", 2))


@query("prj5_prj6_acceptable_answers", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'An acceptable answer is: ' || o_orderstatus || '.' WHEN 1 THEN '' WHEN 2 THEN 'The exact answer is ' || o_custkey || '. Any answer lying in the range from ' || (o_custkey - 5) || ' to ' || (o_custkey + 5) || ' is acceptable.' ELSE 'An acceptable answer is: a.' || chr(10) || 'The exact answer is 7. Any answer lying in the range from 6.5 to 8 is acceptable.' || chr(10) || 'An acceptable answer is: b.' END AS gold FROM orders")
def _acceptable_answers(t) -> DataFrame:
    c = F.col("o_custkey")
    made = (
        F.when(F.col("o_orderkey") % 4 == 0, F.format_string('["%s"]', "o_orderstatus"))
        .when(F.col("o_orderkey") % 4 == 1, F.format_string("[%d, 2.5]", c))
        .when(F.col("o_orderkey") % 4 == 2, F.format_string('[{"wikidata": %d, "range": [%d, %d]}]', c, c - 5, c + 5))
        .otherwise(F.lit('["a", {"wikidata": 7, "range": [6.5, 8]}, 3, "b"]'))
    )
    return t("orders").select("o_orderkey", text.acceptable(text.reference_answers(made)).alias("gold"))
