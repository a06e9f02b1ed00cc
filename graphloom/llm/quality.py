"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over text statistics (byte frequencies, shares of classes of characters, repeated words and lines)
says how far a document's text speaks for or against it: its evidence, the log odds less the sample's prior odds. Evidence
goes up in sums: every host (here: source) and every path below it (here: source and language) gets the number of its documents
and the sum of their posterior means. Method of moments over the hosts gives the strength of the global prior, and over the
paths the strength of the host's; a site's posterior is its own mean shrunk to its parent's, the more the fewer documents it has.
A document's probability joins its evidence with its path's posterior odds.

All statistics of sites come from grouped sums, combined before they are shuffled: a host with a third of all rows is one row a
task. Texts are never shuffled where the sites are few enough to be broadcast (MOST_SITES); beyond that rows join the
sites.

Texts are scanned once where they are not part of the result: the evidence is written beside the other columns. Where they are, they are scanned
twice rather than written. The classifier is fitted on at most about `a_class` labelled rows of each class. Sums are of decimals, so that reruns agree to the last digit.

Defined results: null and empty text have the evidence of an empty text; rows without host share the null host; repeated rows count as
often as they stand; without labels of both classes every document is kept with the probability of the prior; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, materialize, per_doc, spare, text_batches
from graphloom.llm.learn import class_sample, fit_logistic, texts_of

MOST_SITES = 50_000
"""Sites that are broadcast at most."""
MOST_DOCS = 2048
OUTPUTS = ("evidence", "host_posterior", "path_posterior", "score", "keep")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


UPPER = _table(bytes(range(65, 91)))
LOWER = _table(bytes(range(97, 123)))
DIGIT = _table(b"0123456789")
SPACE = _table(b" \t\n\r\x0b\x0c")
MARK = _table(b".,;:'\"()?-")
ODD = ~(UPPER | LOWER | DIGIT | SPACE | MARK) & (np.arange(256) < 128)


def _distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct keys of each document; first: where each document's keys begin."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    both = np.sort((doc << np.uint64(40)) | (keys >> np.uint64(24)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return np.bincount((both[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def text_features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(np.float64)
    share = lambda t: per_doc(t[raw], off) / size
    w = Words(raw, off, "space")
    words = np.diff(w.first)
    ends = np.zeros(0, bool)
    if len(raw):
        ends = ODD[raw[w.end - 1]]
    letters = share(UPPER) + share(LOWER)
    breaks = per_doc(raw == 10, off)
    distinct = _distinct(w.hash, w.first) if len(w.hash) else np.zeros(n)
    pairs = np.zeros(n)
    if len(w.hash):
        with np.errstate(over="ignore"):
            g = w.hash * np.uint64(0xD6E8FEB86659FD93)
            g[:-1] += w.hash[1:]
            # A document's last word makes no pair with the next document's first.
            last = w.first[1:][words > 0] - 1
            g[last] = w.hash[last]
        pairs = _distinct(g, w.first)
    hist = np.bincount(np.repeat(np.arange(n) * 256, np.diff(off)) + raw, minlength=n * 256).reshape(n, 256) / size[:, None]
    some = np.maximum(words, 1)
    cols = [
        share(UPPER) / np.maximum(letters, 0.01), share(DIGIT), share(ODD), share(MARK), share(SPACE), letters,
        np.log1p(words), size / some / 10.0, per_doc(ends, w.first) / some, breaks / some,
        distinct / some, pairs / some, (words > 20) * (1 - distinct / some), (words > 20) * (1 - pairs / some),
    ]
    return np.hstack([np.array(cols).T, np.sqrt(hist)]).astype(np.float32)


@dataclass
class QualityModel:
    w: np.ndarray
    b: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    fitted: bool = True

    def evidence(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        if not self.fitted:
            return np.zeros(len(off) - 1)
        x = (text_features(raw, off) - self.mean) / self.scale
        return np.clip(x @ self.w[:, 0] + self.b, -12, 12).astype(np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", a_class: int = 1000) -> QualityModel:
    """Classes are weighed alike, so that the margin is the evidence; the prior is the labelled rows' share of good."""
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).filter("id is not null")
    some, counts = class_sample(marks, F.col("id"), F.when(F.col("y") > 0, 1).when(F.col("y") == 0, 0), a_class)
    good, bad = counts.get(1, 0), counts.get(0, 0)
    prior = (good + 1.0) / (good + bad + 2.0)
    if not good or not bad:
        return QualityModel(np.zeros((1, 1)), 0.0, np.zeros(1), np.ones(1), prior, False)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = sorted((r["id"], r["text"], r["_label"]) for r in texts_of(own, some).collect())
    if len({y for _, _, y in rows}) < 2:
        return QualityModel(np.zeros((1, 1)), 0.0, np.zeros(1), np.ones(1), prior, False)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows], pa.large_string())], ["text"])
    x = np.concatenate([text_features(raw, off) for _, _, raw, off in text_batches(batch, 0, MOST_DOCS)])
    y = np.array([c for _, _, c in rows], np.float32)[:, None]
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    share = np.bincount(y[:, 0].astype(int), minlength=2)
    w, b = fit_logistic((x - mean) / scale, y, weight=1.0 / share[y[:, 0].astype(int)], l2=1e-3, steps=300, rate=0.05)
    return QualityModel(w, float(b[0]), mean, scale, prior)


def _with_evidence(docs: DataFrame, model: QualityModel, text_col: str, keep: list[str]) -> DataFrame:
    """docs with `evidence`; only the columns in keep go through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(spare(docs.columns, "text_of")[0]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.evidence(raw, off) for _, _, raw, off in text_batches(b, b.num_columns - 1, MOST_DOCS)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def exact_sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of its rows: of nine decimals."""
    return F.sum(x.cast("decimal(28,9)")).cast("double")


def site_posteriors(sums: DataFrame, prior: float) -> DataFrame:
    """(host, path, n, host_posterior, path_posterior) from (host, path, n, total): numbers and sums of the documents' posterior means."""
    hosts = sums.groupBy("host").agg(F.sum("n").alias("host_n"), exact_sum(F.col("total")).alias("host_total"))

    def strength(rows: DataFrame, n: Column, mean: Column, parent: Column) -> float:
        # Between-site variance by the method of moments; alpha = m (1 - m) / variance - 1, kept between 1 and 10000.
        within, between = rows.agg(exact_sum(n * parent * (1 - parent)), exact_sum(n * (mean - parent) * (mean - parent))).first()
        return float(min(1e4, max(1.0, (within or 0.0) / max(between or 0.0, 1e-9) - 1)))

    m0 = F.lit(float(prior))
    alpha = strength(hosts, F.col("host_n"), F.col("host_total") / F.col("host_n"), m0)
    top = hosts.withColumn("host_posterior", (F.col("host_total") + alpha * m0) / (F.col("host_n") + alpha)).select(F.col("host").alias("_h"), "host_posterior")
    below = sums.join(top, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    beta = strength(below, F.col("n"), F.col("total") / F.col("n"), F.col("host_posterior"))
    return below.select("host", "path", "n", "host_posterior", ((F.col("total") + beta * F.col("host_posterior")) / (F.col("n") + beta)).alias("path_posterior"))


def classify_quality(docs: DataFrame, model: QualityModel, host: Column, path: Column, text_col: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Adds evidence, host_posterior, path_posterior, score (probability of good) and keep; without keep_text the text column goes."""
    rows = docs.drop(*OUTPUTS)
    c_host, c_path, c_h, c_p = spare(rows.columns, "host_of", "path_of", "host_at", "path_at")
    rows = rows.withColumns({c_host: host.cast("string"), c_path: path.cast("string")})
    if keep_text:
        lone, scored = _with_evidence(rows, model, text_col, [c_host, c_path]), _with_evidence(rows, model, text_col, rows.columns)
    else:
        lone = scored = materialize(_with_evidence(rows, model, text_col, [c for c in rows.columns if c != text_col]), "quality-evidence")
    mean = F.lit(1.0) / (1.0 + F.exp(-(F.col("evidence") + float(np.log(model.prior / (1 - model.prior))))))
    sums = lone.groupBy(F.col(c_host).alias("host"), F.col(c_path).alias("path")).agg(F.count(F.lit(1)).alias("n"), exact_sum(mean).alias("total"))
    sites = materialize(site_posteriors(materialize(sums, "quality-sums"), model.prior), "quality-sites")
    sites = sites.select(F.col("host").alias(c_h), F.col("path").alias(c_p), "host_posterior", "path_posterior")
    if sites.count() <= MOST_SITES:
        sites = F.broadcast(sites)
    scored = scored.join(sites, F.col(c_host).eqNullSafe(F.col(c_h)) & F.col(c_path).eqNullSafe(F.col(c_p)), "left")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    score = 1.0 / (1.0 + F.exp(-(F.col("evidence") + F.log(p / (1 - p)))))
    return scored.withColumn("score", score).withColumn("keep", F.col("score") >= threshold).drop(c_host, c_path, c_h, c_p)


__all__ = ["QualityModel", "classify_quality", "fit_quality", "site_posteriors", "text_features"]
