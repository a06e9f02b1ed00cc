"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, read_table, shared_dir, spare
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.mixing import mix_sources
from graphloom.llm.ngram_join import Rule, join_components
from graphloom.llm.pii import find_personal_data, fit_spans
from graphloom.llm.quality import classify_quality, fit_quality
from graphloom.plans.tables import discard

RULE = Rule(width=5, percent=80)
"""Near-duplicates: shingles of five words, similarity of 0.8 or more."""
MOST_SENT = 1_000_000
"""Keys of rows that are broadcast at most, 8 bytes each."""


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return classify_quality(docs, model, F.col("source"), F.concat_ws("/", "source", "lang")).filter("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts, that of the smallest id, null ids last; rows that share an id are told apart by their text.

    Texts without words are linked with nothing: their rows all stay, repeated or not.
    """
    key = F.xxhash64("doc_id", F.col("text").cast("string"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key.alias("key"))
    found = join_components(docs.select(row.alias("row"), "text"), "row", rule=RULE)
    c_key, c_n = spare(docs.columns, "row_key", "row_n")
    rows = found.filter("n_shingles > 0").groupBy(F.col("row.key").alias(c_key), (F.col("component_id") != F.col("row")).alias("gone")).agg(F.count(F.lit(1)).alias("n"))
    marked = materialize(rows.filter("gone OR n > 1").select(c_key, "gone"), "marked")
    # A list of keys this short is sent to the texts; a longer one meets them in a join.
    few = marked.count() <= MOST_SENT
    sent = lambda keys: F.broadcast(keys.select(c_key)) if few else keys.select(c_key)
    kept = docs.join(sent(marked.filter("gone")), key == F.col(c_key), "left_anti")
    twice = marked.filter("NOT gone")
    if not twice.limit(1).count():
        return kept.select(*docs.columns)
    # Of rows of one id and one text, the first by the hash of all columns: one row a group and task before the shuffle.
    repeats = kept.join(sent(twice), key == F.col(c_key), "left_semi").groupBy(key.alias(c_key)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(c_n)).select(f"{c_n}.*")
    return kept.join(sent(twice), key == F.col(c_key), "left_anti").select(*docs.columns).unionByName(repeats)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: one passage of one item is contamination enough to keep a text out of training."""
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("items") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    found = find_personal_data(docs, fit_spans(docs), redact=True)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document, the words that the mix takes of it."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
]

ORACLE_SQL = None
"""The first stage is a trained model: SQL can't express it."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        spent, docs = docs, spark.read.parquet(path)
        docs.stored_at = path
        discard(spent)
    return docs
