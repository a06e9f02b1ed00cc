"""Scans and sinks: JSON lines, id lists, edge lists, image folders, and runs that go on where the last one ended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import base64, escaped_json, extension, file_name, is_image, media_type, stem, strip
from graphloom.plans.tables import materialize, shared_dir

CORRUPT = "_corrupt_record"
MOST_COPIES = 10_000
"""Files that copy_images copies at most: a sample."""


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines by a stated schema. strict: a line that doesn't fit fails the read; else it stands in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*typed.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").json(path)


def read_ids(spark: SparkSession, path: str, blanks: bool = False) -> DataFrame:
    """(id) of a text file of one id a line, stripped; blank lines are dropped unless asked for."""
    rows = spark.read.text(path).select(strip("value").alias("id"))
    return rows if blanks else rows.filter("id <> ''")


def read_edges(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(a, b) of a tab-separated file without quoting. comments: lines that begin with # are left out. Blank names fail."""
    reader = spark.read.schema("a string, b string").option("sep", "\t").option("quote", "").option("escape", "")
    rows = (reader.option("comment", "#") if comments else reader).csv(path)
    bad = F.coalesce(F.length(strip("a")), F.lit(0)) * F.coalesce(F.length(strip("b")), F.lit(0)) == 0
    return rows.withColumn("a", F.when(bad, F.raise_error(F.lit("edge without a name"))).otherwise(F.col("a")))


def read_images(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """(path, id, ext, content) of the image files below the paths; paths without files (missing shards) are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    jvm = spark.sparkContext._jvm
    there = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            there.append(p)
    if not there:
        return spark.createDataFrame([], "path string, id string, ext string, content binary")
    rows = reader.load(there)
    return rows.filter(is_image("path")).select("path", stem("path").alias("id"), extension("path").alias("ext"), "content")


def encoded_images(images: DataFrame) -> DataFrame:
    """Adds b64 and mime."""
    return images.withColumns({"b64": base64("content"), "mime": media_type("path")})


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite", ascii_only: bool = False) -> None:
    """One JSON object a line; ascii_only: other code points as escapes, which readers decode."""
    if ascii_only:
        rows.select(escaped_json(F.to_json(F.struct(*rows.columns))).alias("value")).write.mode(mode).text(path)
    else:
        rows.write.mode(mode).json(path)


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated names without quoting; nodes without edges have no line."""
    edges.select("a", "b").write.mode(mode).option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path)


def write_blocks(contexts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(rank, content) as numbered text blocks."""
    contexts.orderBy("rank").select(F.concat_ws("\n", F.concat(F.lit("Context "), F.col("rank").cast("string"), F.lit(":")), F.col("content"), F.lit("")).alias("value")).write.mode(mode).text(path)


def copy_images(images: DataFrame, target: str) -> DataFrame:
    """Copies the files of sampled images (path; a bounded sample) to the target folder, which is wiped first; the images as they lie there.

    Copies go through the file systems of the paths, one by one, as the sample is small.
    """
    spark = images.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(target)
    paths = sorted(r["path"] for r in images.select("path").distinct().limit(MOST_COPIES + 1).collect())
    if len(paths) > MOST_COPIES:
        raise ValueError(f"more than {MOST_COPIES} files to copy")
    fs = to.getFileSystem(conf)
    fs.delete(to, True)
    fs.mkdirs(to)
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        jvm.org.apache.hadoop.fs.FileUtil.copy(at.getFileSystem(conf), at, fs, to, False, True, conf)
    return read_images(spark, target)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, through the file system of its path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def required(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows with the columns of other, by key; a row whose key other lacks fails the query."""
    found = rows.join(other.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[key].dataType)).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("_there")


def question_images(rows: DataFrame, path: str) -> DataFrame:
    """Adds image_id, the file name of an image before its only dot; a name of another form, or one that isn't an image's, fails."""
    name = file_name(path)
    good = is_image(path) & (F.size(F.split(name, "[.]")) == 2)
    return rows.withColumn("image_id", F.when(good, F.split_part(name, F.lit("."), F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.coalesce(F.col(path), F.lit("null"))))))


def checked_done(done: DataFrame, key: str, kind: str, wanted: str) -> DataFrame:
    """Finished rows (key, kind), all of which must be of the wanted kind, else the query fails."""
    return done.withColumn(key, F.when(F.col(kind) == wanted, F.col(key)).otherwise(F.raise_error(F.lit(f"a finished row is not of kind {wanted}")).cast(done.schema[key].dataType)))


def not_done(rows: DataFrame, done: DataFrame, key: str, again: str | None = None) -> DataFrame:
    """Rows whose key is not among the finished ones; again: a condition under which a finished row is to be done again."""
    done = done if again is None else done.filter(f"NOT coalesce({again}, false)")
    return rows.join(done.select(key).distinct(), key, "left_anti")


def resume(spark: SparkSession, rows: DataFrame, path: str, key: str, step, schema: str) -> DataFrame:
    """Applies step to rows that path doesn't have yet and appends them; returns the whole."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        done = spark.createDataFrame([], schema)
    step(not_done(rows, done, key)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cached_stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made and written if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.parquet(path)
    return spark.read.parquet(path)


def checked_copies(copied: DataFrame, required: DataFrame) -> DataFrame:
    """One row: number of copied files; fails if one is not an image or not required."""
    stray = copied.join(required.select("path").distinct(), "path", "left_anti").select(F.count(F.lit(1)).alias("stray"))
    odd = copied.agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_image("path")).alias("odd"))
    return odd.join(stray, F.lit(True)).select(F.when((F.col("odd") > 0) | (F.col("stray") > 0), F.raise_error(F.lit("copied file that is not a required image"))).otherwise(F.col("n")).alias("n"))


def paired_prefix(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (pos, id, embedding) of two lists (pos, id) and (pos, embedding) that count from 0, the longer of which is cut to the shorter one's length."""
    n = min(ids.count(), vectors.count())
    return ids.filter(F.col("pos") < n).join(vectors.filter(F.col("pos") < n), "pos")


def round_trip(rows: DataFrame, kind: str) -> DataFrame:
    """Writes rows in the shared folder and reads them back: json, edges or parquet."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    if kind == "json":
        write_jsonl(rows, path)
        return read_jsonl(spark, path, rows.schema)
    if kind == "edges":
        write_edges(rows, path)
        return read_edges(spark, path)
    return materialize(rows, "round-trip")


__all__ = ["cached_stage", "checked_copies", "checked_done", "copy_images", "encoded_images", "file_name", "not_done", "paired_prefix", "read_edges", "read_ids", "read_images", "read_jsonl", "required", "question_images", "resume", "round_trip", "write_blocks", "write_edges", "write_file", "write_jsonl"]
