"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is the sum of its own learned vector (words of the training sample's vocabulary; else unknown) and the learned vectors of all its
byte trigrams (hashed, its ends marked, divided by the root of their number). Two gated recurrent networks, one a direction, run over windows of WINDOW
words; attention pools their states, and a logistic unit scores the window. Windows overlap, the last one ends with the
text, and a document's logit is that of its most toxic window, calibrated.

As inputs enter the gates linearly, each direction's input products are computed once for every vector (tables of the
size of the vocabulary) and summed once for every distinct word of a slice of texts, so that scoring gathers rows instead of multiplying.

Training: at most about `a_class` labelled documents of each class and the `most_words` most telling words (the bounds; whole texts). Labels are a document's, not a window's: a
toxic document counts by its most suspicious window (first by the words' log odds, then by the network's own score), the others by windows
drawn at random and the most suspicious one. The calibration weighs the classes as all labelled rows have them.

Defined results: null and empty text are one window of no words, scored like any other; repeated rows are scored each on their own; without
labels of both classes, or without a word in the sample, every score is the share of toxic rows seen (0 without any); input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, text_batches
from graphloom.llm.learn import class_sample, fit_logistic, sigmoid, texts_of

WINDOW = 32
STRIDE = 24
HIDDEN = 8
DIM = 8
CHAR_BITS = 11
MOST_WORDS = 8192
"""Words with a vector of their own, unless stated otherwise; the others have those of their trigrams."""
MOST_DOCS = 4096
MOST_WINDOWS = 4096


@dataclass
class Forms:
    """Distinct words: their hashes in order, and the slots of their trigrams, word after word."""

    hash: np.ndarray
    slots: np.ndarray
    count: np.ndarray

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word the sum of its trigrams' rows, divided by the root of their number."""
        if not len(self.count):
            return np.zeros((0, table.shape[1]), table.dtype)
        begin = np.cumsum(self.count) - self.count
        return np.add.reduceat(table[self.slots], begin, axis=0) / np.sqrt(self.count).astype(table.dtype)[:, None]

    def only(self, own: np.ndarray) -> Forms:
        """The words of these numbers."""
        count = self.count[own]
        return Forms(self.hash[own], self.slots[_runs((np.cumsum(self.count) - self.count)[own], count)], count)


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, `count` numbers for each."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def forms_of(raw: np.ndarray, w: Words) -> tuple[Forms, np.ndarray]:
    """The distinct words, and the number among them of each word."""
    own, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], (w.end - w.start)[first]
    if not len(own):
        return Forms(own, np.zeros(0, np.int32), np.zeros(0, np.int64)), number
    at, word = _runs(start, size), np.repeat(np.arange(len(own)), size)
    low = raw.astype(np.uint32)
    low[(raw >= 65) & (raw <= 90)] += np.uint32(32)
    before = np.where(at > start[word], low[np.maximum(at - 1, 0)], 1)
    after = np.where(at < start[word] + size[word] - 1, low[np.minimum(at + 1, len(raw) - 1)], 2)
    g = (before << np.uint32(16)) | (low[at] << np.uint32(8)) | after
    return Forms(own, ((g.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)).astype(np.int32), size.astype(np.int64)), number


def merged_forms(parts: list[Forms]) -> Forms:
    every, first = np.unique(np.concatenate([f.hash for f in parts]), return_index=True)
    count = np.concatenate([f.count for f in parts])
    begin = np.cumsum(count) - count
    return Forms(every, np.concatenate([f.slots for f in parts])[_runs(begin[first], count[first])], count[first])


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length) of every window; a document of no words has one of length 0."""
    n = np.diff(first)
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return doc, first[:-1][doc] + start, np.minimum(n[doc] - start, WINDOW)


def _init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, 0.4, (DIM, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
    return p | {"v": rng.normal(0, 0.3, 2 * HIDDEN), "o": rng.normal(0, 0.3, 2 * HIDDEN), "k": np.array([-1.0])}


def _run(a: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (time, rows, HIDDEN) of one gated recurrent network; a: input products (time, rows, 3 HIDDEN), of update, reset and new."""
    steps, rows, _ = a.shape
    h = np.zeros((rows, HIDDEN), a.dtype)
    out = np.empty((steps, rows, HIDDEN), a.dtype)
    for t in range(steps):
        g = h @ u
        zr = 1.0 / (1.0 + np.exp(-(a[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = 2.0 / (1.0 + np.exp(-2.0 * (a[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :]))) - 1.0
        if keep is not None:
            keep.append((h, z, r, new, g[:, 2 * HIDDEN :]))
        nxt = new + z * (h - new)
        h = nxt if mask is None else np.where(mask[t][:, None], nxt, h)
        out[t] = h
    return out


def _pool(h: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention and pooled states."""
    e = np.where(mask, h @ p["v"], -1e9)
    e = np.exp(e - e.max(0, keepdims=True)) * mask
    att = e / np.maximum(e.sum(0, keepdims=True), 1e-9)
    pooled = (att[:, :, None] * h).sum(0)
    return pooled @ p["o"] + p["k"][0], att, pooled


@dataclass
class Network:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    a: float = 1.0
    b: float = 0.0
    share: float = 0.0
    fitted: bool = False

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 is unknown."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int32)
        at = self.lookup[(hashes >> np.uint64(48)).astype(np.int64)]
        found = np.zeros(len(hashes), np.int32)
        for k in range(self.run):
            own = np.minimum(at + k, len(self.words) - 1)
            found = np.where(self.words[own] == hashes, own + 1, found)
        return found.astype(np.int32)

    def file(self) -> None:
        """Where the 16 leading bits of a hash begin in the vocabulary, and the longest run of words that share them."""
        lead = (self.words >> np.uint64(48)).astype(np.int64)
        self.lookup = np.searchsorted(lead, np.arange(1 << 16))
        self.run = int(np.bincount(lead).max()) if len(lead) else 0

    def prepare(self) -> None:
        """Tables for scoring: input products of every vector."""
        for d in "fb":
            w = self.p[f"W{d}"]
            self.tables[f"w{d}"] = (self.p["E"] @ w + self.p[f"c{d}"]).astype(np.float32)
            self.tables[f"h{d}"] = (self.p["H"] @ w).astype(np.float32)

    def logits(self, forms: Forms, number: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of each window of words (numbers of forms)."""
        out = np.empty(len(start), np.float32)
        p32 = {k: self.p[k].astype(np.float32) for k in ("Uf", "Ub", "v", "o", "k")}
        ids = self.index(forms.hash)
        products = {d: self.tables[f"w{d}"][ids] + forms.sums(self.tables[f"h{d}"]) for d in "fb"}
        full = length == WINDOW
        for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
            for i in range(0, len(rows), MOST_WINDOWS):
                own = rows[i : i + MOST_WINDOWS]
                steps = max(1, int(length[own].max()))
                at = start[own][None, :] + np.arange(steps)[:, None]
                mask = np.arange(steps)[:, None] < length[own][None, :]
                whole = bool(mask.all())
                at = np.minimum(at, max(len(number) - 1, 0))
                got = {d: products[d][number[at]] if len(number) else np.zeros((*at.shape, 3 * HIDDEN), np.float32) for d in "fb"}
                hf = _run(got["f"], p32["Uf"], None if whole else mask, None)
                hb = _run(got["b"][::-1], p32["Ub"], None if whole else mask[::-1], None)[::-1]
                out[own] = _pool(np.concatenate([hf, hb], 2), mask, p32)[0]
        return out

    def window_logits(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word in the slice, logit) of every window."""
        w = Words(raw, off, "alnum")
        forms, number = forms_of(raw, w)
        doc, start, length = windows_of(w.first)
        return doc, start, self.logits(forms, number, start, length)

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not self.fitted:
            return np.full(n, self.share)
        doc, _, logit = self.window_logits(raw, off)
        best = np.full(n, -1e9)
        np.maximum.at(best, doc, logit)
        return sigmoid(self.a * best + self.b)


def _gradients(p: dict, x: np.ndarray, ids: np.ndarray, at: np.ndarray, forms: Forms, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss of a batch and its gradients, by backpropagation through time. at: which of forms each word is."""
    states, kept = {}, {"f": [], "b": []}
    turn = {"f": lambda m: m, "b": lambda m: m[::-1]}
    for d in "fb":
        states[d] = turn[d](_run(turn[d](x) @ p[f"W{d}"] + p[f"c{d}"], p[f"U{d}"], turn[d](mask), kept[d]))
    h = np.concatenate([states["f"], states["b"]], 2)
    logit, att, pooled = _pool(h, mask, p)
    q = sigmoid(logit)
    loss = float(-(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum())
    dl = weight * (q - y)
    g = {"o": pooled.T @ dl, "k": np.array([dl.sum()])}
    dpool = dl[:, None] * p["o"]
    datt = (h * dpool[None]).sum(2)
    de = att * (datt - (att * datt).sum(0, keepdims=True))
    g["v"] = np.einsum("tb,tbh->h", de, h)
    dh = att[:, :, None] * dpool[None] + de[:, :, None] * p["v"]
    dx = np.zeros_like(x)
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        dhs, m = turn[d](dh[:, :, part]), turn[d](mask)
        u, da = p[f"U{d}"], np.zeros((*x.shape[:2], 3 * HIDDEN))
        back, du = np.zeros((x.shape[1], HIDDEN)), np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, new, gn = kept[d][t]
            cur = (dhs[t] + back) * m[t][:, None]
            passed = (dhs[t] + back) - cur
            dn = cur * (1 - z) * (1 - new * new)
            dz = cur * (before - new) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da[t] = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dn * r], 1)
            du += before.T @ dg
            back = cur * z + dg @ u.T + passed
        g[f"U{d}"], g[f"c{d}"] = du, da.sum((0, 1))
        g[f"W{d}"] = np.einsum("tbd,tbk->dk", turn[d](x), da)
        dx += turn[d](da @ p[f"W{d}"].T)
    flat = dx.reshape(-1, DIM)
    g["E"], g["H"] = np.zeros_like(p["E"]), np.zeros_like(p["H"])
    np.add.at(g["E"], ids.ravel(), flat)
    # Each word's gradient goes to all its trigrams.
    each = np.zeros((len(forms.count), DIM))
    np.add.at(each, at.ravel(), flat)
    np.add.at(g["H"], forms.slots, np.repeat(each / np.sqrt(forms.count)[:, None], forms.count, axis=0))
    return loss, g


def train(texts: list[str], labels: list[int], share: float, seed: int = 1, epochs: int = 14, most_words: int = MOST_WORDS) -> Network:
    """share: of toxic rows among all labelled ones."""
    net = Network(share=share)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return net
    rng = np.random.default_rng(seed)
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts], pa.large_string())], ["text"])
    hashes, parts, first = [], [], [0]
    for _, _, raw, off in text_batches(batch, 0, MOST_DOCS):
        w = Words(raw, off, "alnum")
        hashes.append(w.hash)
        parts.append(forms_of(raw, w)[0])
        first += (w.first[1:] + first[-1]).tolist()
    hashes, forms, first = np.concatenate(hashes), merged_forms(parts), np.array(first)
    if not len(hashes):
        return net
    # Vocabulary and its log odds: in how many documents of either class each word is.
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    words = forms.hash
    number = np.searchsorted(words, hashes)
    pairs = np.unique(number * len(texts) + doc)
    wd, dd = pairs // len(texts), pairs % len(texts)
    seen = np.bincount(wd, minlength=len(words))
    bad = np.bincount(wd, weights=y[dd], minlength=len(words))
    n1, n0 = y.sum(), (1 - y).sum()
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((seen - bad + 0.5) / (n0 + 1))
    telling = np.abs(odds) * np.sqrt(seen)
    own = np.sort(np.argsort(-telling, kind="stable")[: min(most_words, int((seen >= 4).sum()))])
    own = own[seen[own] >= 4]
    net.words = words[own]
    net.file()
    p = _init(rng)
    p["E"] = rng.normal(0, 0.05, (len(own) + 1, DIM))
    p["E"][1:, 0] += np.clip(odds[own], -3, 5) * (seen[own] >= 4) * 0.5
    p["H"] = rng.normal(0, 0.02, (1 << CHAR_BITS, DIM))
    net.p = p
    ids = net.index(words)[number]
    at_doc, start, length = windows_of(first)
    fit = rng.random(len(texts)) < 0.8
    word_odds = np.concatenate([[0.0], odds[own]])[ids] if len(ids) else np.zeros(0)
    suspect = np.array([word_odds[s : s + n].max() if n else -9.0 for s, n in zip(start, length, strict=True)])
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    lone = np.flatnonzero(np.append(True, at_doc[1:] != at_doc[:-1]))
    for epoch in range(epochs):
        if epoch >= 4 and epoch % 2 == 0:
            net.prepare()
            suspect = net.logits(forms, number, start, length)
        order = np.lexsort((-suspect, at_doc))
        top = order[lone]
        others = rng.integers(0, len(start), 2 * len(top))
        others = others[(y[at_doc[others]] == 0)]
        pick = np.concatenate([top, others])
        pick = rng.permutation(pick[fit[at_doc[pick]]])
        for i in range(0, len(pick), 128):
            w = pick[i : i + 128]
            steps = max(1, int(length[w].max()))
            mask = np.arange(steps)[:, None] < length[w][None, :]
            at = np.minimum(start[w][None, :] + np.arange(steps)[:, None], len(ids) - 1)
            own, place = np.unique(number[at].ravel(), return_inverse=True)
            near, place = forms.only(own), place.reshape(at.shape)
            bi = ids[at] * mask
            bi = np.where(rng.random(bi.shape) < 0.05, 0, bi)
            x = p["E"][bi] + near.sums(p["H"])[place]
            yw = y[at_doc[w]].astype(float)
            weight = np.full(len(w), 1.0 / len(w))
            _, g = _gradients(p, x, bi, place, near, mask, yw, weight)
            step += 1
            for k in p:
                gk = g[k] + (1e-5 * p[k] if k in "EH" else 1e-4 * p[k])
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    net.prepare()
    best = np.full(len(texts), -1e9)
    np.maximum.at(best, at_doc, net.logits(forms, number, start, length))
    held = ~fit if len(set(y[~fit])) == 2 else np.ones(len(texts), bool)
    x = np.clip(best[held], -20, 20)[:, None]
    weight = np.where(y[held] == 1, share / max(1, (y[held] == 1).sum()), (1 - share) / max(1, (y[held] == 0).sum()))
    a, b = fit_logistic(x.astype(np.float32), y[held][:, None].astype(np.float32), weight=weight, l2=1e-3, steps=400, rate=0.05)
    net.a, net.b, net.fitted = max(float(a[0, 0]), 1e-3), float(b[0]), True
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", a_class: int = 1000, most_words: int = MOST_WORDS) -> Network:
    """allowed: which rows of labels may be learned from."""
    marks = labels.filter(allowed).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).filter("id is not null")
    some, counts = class_sample(marks, F.col("id"), F.when(F.col("y") > 0, 1).when(F.col("y") == 0, 0), a_class)
    bad, good = counts.get(1, 0), counts.get(0, 0)
    share = bad / (bad + good) if bad + good else 0.0
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = sorted((r["id"], r["text"], r["_label"]) for r in texts_of(own, some).collect()) if counts else []
    return train([t for _, t, _ in rows], [c for _, _, c in rows], share, most_words=most_words)


def score_toxicity(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Adds score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.drop("score")
    columns, at = rows.columns, rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.scores(raw, off) for _, _, raw, off in text_batches(b, at, MOST_DOCS)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], [*columns, "score"])

    return rows.mapInArrow(run, schema)
