"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier a bit, a logistic regression over hashed byte trigrams of
the letters (log counts, unit length), says how likely the bit is. Decoding sums over the bits the logistic loss of the
classifier's margin against a language's bit, weighted by how well that classifier did in training; the
language of least loss is the prediction. A document is ambiguous when the second-best language comes within `gap`.

For up to five languages the code is exhaustive (every way to split them in two); for more, the columns are drawn at random
and the draw of greatest minimal distance is kept.

The model is fitted on a sample of at most about `a_language` documents of each language and `most_rows` in all, but four of each language if there
are that many (the bounds; whole texts); every language is learned. Predictions use the text alone, whole, and stay within the row.

Defined results: `und` with score 0 where the text is null, empty or has no letter, or no language could be learned; repeated rows are predicted
each on their own; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import column_bytes, per_doc, text_batches
from graphloom.llm.learn import MOST_ROWS, class_sample, fit_logistic

DIMS = 1 << 12
MOST_DOCS = 512


def _folded() -> np.ndarray:
    """Byte table: A-Z as a-z, other ASCII but letters as space."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


FOLD = _folded()
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def trigram_features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, DIMS) unit vectors of log counts of hashed byte trigrams."""
    n = len(off) - 1
    if len(raw) < 3:
        return np.zeros((n, DIMS), np.float32)
    b = FOLD[raw].astype(np.uint32)
    g = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = (g * np.uint32(2654435761)) >> np.uint32(32 - 12)
    doc = np.repeat(np.arange(n), np.diff(off))
    inside = (doc[:-2] == doc[2:]) & (g != np.uint32(0x202020))
    counts = np.bincount(doc[:-2][inside] * DIMS + slot[inside], minlength=n * DIMS).reshape(n, DIMS)
    x = np.log1p(counts.astype(np.float32))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-6)


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A code point of Unicode's categories L, which digits, superscripts, fractions and Roman numerals are not."""
    found = per_doc(ASCII_LETTER[raw], off) > 0
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def code_matrix(n: int, seed: int = 1) -> np.ndarray:
    """(languages, bits) of 0 and 1: rows far apart, no column constant."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [set(c) | {0} for k in range(n - 1) for c in combinations(range(1, n), k)]
        return np.array([[int(i in s) for s in splits] for i in range(n)], np.int8)
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(50):
        m = rng.integers(0, 2, (n, 10 * int(np.ceil(np.log2(n))))).astype(np.int8)
        m = m[:, (m.sum(0) > 0) & (m.sum(0) < n)]
        apart = -1
        if m.size:
            far = m.astype(int) @ (1 - m.T.astype(int))
            apart = int((far + far.T)[np.triu_indices(n, 1)].min())
        if apart > least:
            best, least = m, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weight: np.ndarray
    sharp: float

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, its probability, gap to the second), for each document."""
        n = len(off) - 1
        if len(self.languages) < 2:
            return np.zeros(n, int), np.ones(n), np.ones(n)
        margin = trigram_features(raw, off) @ self.w + self.b
        loss = np.logaddexp(0.0, -margin) @ (self.weight * self.code).T + np.logaddexp(0.0, margin) @ (self.weight * (1 - self.code)).T
        p = np.exp(-self.sharp * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return p.argmax(1), p.max(1), order[:, -1] - order[:, -2]


def train(texts: list[str], labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    code = code_matrix(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32), np.ones(1), 1.0)
    raw, off = column_bytes(pa.array(texts, pa.large_string()))
    x = np.concatenate([trigram_features(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in ((i, min(i + MOST_DOCS, len(texts))) for i in range(0, len(texts), MOST_DOCS))])
    of = np.searchsorted(languages, labels)
    y = code[of].astype(np.float32)
    share = np.bincount(of, minlength=len(languages))
    w, b = fit_logistic(x, y, weight=1.0 / share[of], steps=120, rate=0.3)
    wrong = np.clip(((x @ w + b > 0) != (y > 0.5)).mean(0), 0.01, 0.49)
    weight = np.log((1 - wrong) / wrong)
    return LanguageModel(languages, code, w, b, weight / weight.sum(), 6.0)


def fit_languages(docs: DataFrame, text_col: str, lang: Column, key: Column, a_language: int = 300, most_rows: int = MOST_ROWS) -> LanguageModel:
    rows = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"), key.alias("key")).filter("text is not null")
    sample, _ = class_sample(rows, F.col("key"), F.col("lang"), a_language, most_rows)
    # One row a key, however often it is repeated: the sample stays bounded.
    sample = sample.groupBy(F.col("key").cast("string").alias("key")).agg(F.min(F.struct("text", "_label")).alias("r")).select("key", "r.*")
    got = sorted((r["key"] or "", r["text"], r["_label"]) for r in sample.collect())
    return train([t for _, t, _ in got], [c for _, _, c in got])


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", gap: float = 0.2) -> DataFrame:
    """Adds lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score", "ambiguous")
    columns, at = rows.columns, rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score, unsure = [], [], []
            for _, _, raw, off in text_batches(b, at, MOST_DOCS):
                known = has_letter(raw, off) & bool(m.languages)
                best, p, apart = m.predict(raw, off)
                lang += [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score += np.where(known, p, 0.0).tolist()
                unsure += (~known | (apart < gap)).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*columns, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)


__all__ = ["LanguageModel", "code_matrix", "fit_languages", "identify_languages", "train"]
