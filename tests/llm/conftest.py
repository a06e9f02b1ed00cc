from __future__ import annotations

import random

import pytest
from made_texts import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators make or use inside, of other types.
CLASH = ["n_words", "hits", "items", "n_hit", "places", "pii", "score", "keep", "evidence", "size", "target", "taken", "lang_pred", "ambiguous", "node", "id", "h", "_words", "words_of", "words_at", "words_from", "host", "_host", "host_of", "path_of", "HOST_AT", "path_at", "text_of", "_text", "text_key", "part", "rank", "shard", "bucket"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, letters beyond ASCII and columns with clashing names."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, "x", "fr", "b", 1), (None, "no id here at all", None, "b", 17),
        (5, words(rng, 60), "en", None, 1), (5, words(rng, 61), "en", "a", 2), (6, "same row", "de", "c", 8), (6, "same row", "de", "c", 8), (None, None, None, None, None),
        (7, "É ß ñ — 中文 🙂 " * 5, "fr", "É", 9), (8, words(rng, 40_000), "en", "a", 9), (9, "w " * 30_000, "en", "a", 9), (10, "longword" * 20_000, "de", "z", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
