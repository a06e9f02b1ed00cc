"""What trained operators and draws return, against plain Python that goes through the same numbers one by one."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from made_texts import words
from pyspark.sql import functions as F

from graphloom.llm import langid, mixing, pii, quality, toxicity
from graphloom.llm.common import Words, column_bytes
from graphloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def slot(code: int, bits: int) -> int:
    return (code * 2654435761 % (1 << 32)) >> (32 - bits)


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40, min(40, x))))


# --- 1 ----------------------------------------------------------------------------------------------------------


def test_taken_counts_the_words_of_the_blocks_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 90), rng.choice("aaaaaabbcd")) for i in range(150)] + [(7, "w " * 33, "a")] * 11 + [(None, "w " * 5, None)] * 9 + [(900, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix_sources(docs, block=8).collect())
    sized = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"))
    targets = mixing.source_targets(sized, (5, 2, 1), 3, 8)
    about = {r["rank"]: r for r in targets.collect()}
    total = sum(r["slots"] for r in about.values())
    counts = mixing.draw_counts(targets, total, 1)
    drawn = Counter()
    for r in counts.collect():
        drawn[r["rank"]] += r["count"]
    assert all(drawn[k] == r["slots"] for k, r in about.items())
    uses = {(r["rank"], r["block"]): r["uses"] for r in mixing.block_uses(counts, 3, 1).collect()}
    assert max(uses.values()) <= 3
    placed = [(r["source"], r["start"], r["id"], r["size"]) for r in mixing.positions(sized).collect()]
    want = Counter((r[0], r[2], 0, 0) for r in rows if not (r[1] or "").split())
    for rank, r in about.items():
        at = 0
        for _, start, i, n in sorted(x for x in placed if x[0] == r["source"]) if r["source"] is not None else sorted((x for x in placed if x[0] is None), key=lambda x: x[1]):
            assert start == at  # word after word
            at += n
            want[i, r["source"], n, sum(uses.get((rank, w // 8), 0) for w in range(start, start + n))] += 1
        assert at == r["source_size"]
    assert got == want


def test_shards_draw_multinomial_counts(spark, monkeypatch):
    n, wide = 40_000, 200
    monkeypatch.setattr(mixing, "LEAST_SHARD", wide)
    targets = spark.createDataFrame([(0, 20_000, 0), (1, 12_000, 20_000), (2, 7_990, 32_000), (3, 10, 39_990)], "rank long, slots long, low long").withColumn("blocks", F.lit(10).cast("long"))
    got = mixing.drawn_counts(targets, n, wide, 3).collect()
    of = Counter()
    for r in got:
        of[r["shard"]] += r["drawn"]
    assert set(of.values()) == {wide}
    assert len(of) == n // wide
    for rank, p in ((0, 0.5), (1, 0.3), (2, 0.19975)):
        own = [r["drawn"] for r in got if r["rank"] == rank]
        assert np.mean(own) == pytest.approx(wide * p, rel=0.03)
        assert np.var(own) == pytest.approx(wide * p * (1 - p), rel=0.35)
    exact = mixing.draw_counts(targets, n, 3).collect()
    sums, shards = Counter(), Counter()
    for r in exact:
        sums[r["rank"]] += r["count"]
        shards[r["shard"]] += r["count"]
    assert sums == {0: 20_000, 1: 12_000, 2: 7_990, 3: 10}
    assert set(shards.values()) == {wide}
    first = {}
    for r in sorted(exact, key=lambda r: (r["rank"], r["shard"])):
        assert r["first"] == first.get(r["rank"], 0)
        first[r["rank"]] = r["first"] + r["count"]
    # Only the last shards are corrected.
    drawn, fixed = {(r["rank"], r["shard"]): r["drawn"] for r in got}, {(r["rank"], r["shard"]): r["count"] for r in exact}
    assert all(drawn.get((k, s)) == fixed.get((k, s)) for k in range(4) for s in range(100))


def test_many_sources_share_what_the_capped_ones_leave(spark):
    rng = random.Random(8)
    sizes = {f"s{i:03d}": rng.choice((0, 1, 5, 40, 400, 3000)) for i in range(120)}
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "id long, source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(sized, (5, 2, 1), 3, 8).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    open_, left, want = set(sizes), float(sum(sizes.values())), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert [r["rank"] for _, r in sorted(got.items())] == list(range(120))
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)
    low = 0
    for _, r in sorted(got.items()):
        assert r["low"] == low
        low += r["slots"]


# --- 2 ----------------------------------------------------------------------------------------------------------


def plain_language(m: langid.LanguageModel, text: str | None) -> tuple[str, float]:
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    low = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    counts = Counter(slot(int.from_bytes(low[i : i + 3], "big"), 12) for i in range(len(low) - 2) if low[i : i + 3] != b"   ")
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
    loss = [0.0] * len(m.languages)
    for bit in range(m.code.shape[1]):
        margin = float(m.b[bit]) + sum(math.log1p(c) / length * float(m.w[s, bit]) for s, c in counts.items())
        for k in range(len(m.languages)):
            loss[k] += float(m.weight[bit]) * math.log1p(math.exp(-margin if m.code[k, bit] else margin))
    p = [math.exp(-m.sharp * (x - min(loss))) for x in loss]
    return m.languages[p.index(max(p))], max(p) / sum(p)


def test_languages_of_the_query(spark, sf):
    from graphloom.llm.common import crc_mod

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_languages(docs.filter(crc_mod(F.col("doc_id"), 4) != 2), "text", F.col("lang"), F.col("doc_id"))
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        lang, p = plain_language(model, text[r["doc_id"]])
        assert r["score"] == pytest.approx(p, abs=1e-4)
        assert r["lang_pred"] == lang or abs(p - 0.5) < 1e-3


def test_texts_without_letters_have_no_language(spark):
    model = langid.train(["the cat sat", "le chat noir", "die katze da"] * 5, ["en", "fr", "de"] * 5)
    rows = [(0, "\u00b2\u00b3 \u00bd"), (1, "\u2163 \u2160"), (2, "12 _ ?"), (3, "\u00aa"), (4, "\u4e2d"), (5, None), (6, "")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert [i for i, x in got.items() if x == "und"] == [0, 1, 2, 5, 6]


def test_no_language_is_left_out(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 12, "abcdefghijklmnopqrstuvwxyz"[i % 7 : i % 7 + 6]), f"l{i % 300}") for i in range(1500)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string"), "text", F.col("lang"), F.col("doc_id"))
    assert len(model.languages) == 300


# --- 3 ----------------------------------------------------------------------------------------------------------


def plain_features(text: str) -> tuple[list[float | None], list[float]]:
    """Shares and counts (None: those of pairs of words), and the roots of the shares of bytes."""
    raw = text.encode()
    n = max(len(raw), 1)
    upper, lower, digit = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122), (48, 57)))
    space, mark = sum(b in b" \t\n\r\x0b\x0c" for b in raw), sum(b in b".,;:'\"()?-" for b in raw)
    odd = lambda b: b < 128 and not (65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57 or b in b" \t\n\r\x0b\x0c.,;:'\"()?-")
    w = [x.encode() for x in SPACE.findall(text)]
    low = [x.lower() for x in w]
    some, letters = max(len(w), 1), (upper + lower) / n
    distinct, long = len(set(low)) / some, float(len(w) > 20)
    cols = [upper / n / max(letters, 0.01), digit / n, sum(map(odd, raw)) / n, mark / n, space / n, letters, math.log1p(len(w)), n / some / 10, sum(odd(x[-1]) for x in w) / some, raw.count(b"\n") / some, distinct, None, long * (1 - distinct), None]
    return cols, [math.sqrt(raw.count(bytes([b])) / n) for b in range(256)]


def test_quality_of_the_query(spark, sf):
    """Features, evidence, grouped sums and both levels of shrinking."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        cols, hist = plain_features(r["text"] or "")
        raw, off = column_bytes(pa.array([r["text"] or ""]))
        x = quality.text_features(raw, off)[0]
        own = [k for k, c in enumerate(cols) if c is not None]
        assert [float(x[k]) for k in own] == pytest.approx([cols[k] for k in own], rel=1e-4, abs=1e-5)
        assert [float(v) for v in x[14:]] == pytest.approx(hist, abs=1e-5)
        evidence = max(-12, min(12, float(((x - model.mean) / model.scale) @ model.w[:, 0]) + model.b))
        assert got[i]["evidence"] == pytest.approx(evidence, abs=1e-3)
    odds = math.log(model.prior / (1 - model.prior))
    host, path = {}, {}
    for i, r in rows.items():
        mean = logistic(got[i]["evidence"] + odds)
        key = "/".join(x for x in (r["source"], r["lang"]) if x is not None)
        for site, name in ((host, r["source"]), (path, (r["source"], key))):
            n, s = site.get(name, (0, 0.0))
            site[name] = (n + 1, s + mean)

    def shrunk(site: dict, parent) -> dict:
        within = sum(n * parent(k) * (1 - parent(k)) for k, (n, s) in site.items())
        between = sum(n * (s / n - parent(k)) ** 2 for k, (n, s) in site.items())
        a = min(1e4, max(1.0, within / max(between, 1e-9) - 1))
        return {k: (s + a * parent(k)) / (n + a) for k, (n, s) in site.items()}

    top = shrunk(host, lambda k: model.prior)
    low = shrunk(path, lambda k: top[k[0]])
    for i, r in rows.items():
        p = low[r["source"], "/".join(x for x in (r["source"], r["lang"]) if x is not None)]
        assert got[i]["host_posterior"] == pytest.approx(top[r["source"]], abs=1e-6)
        assert got[i]["path_posterior"] == pytest.approx(p, abs=1e-6)
        score = logistic(got[i]["evidence"] + math.log(p / (1 - p)))
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
        assert got[i]["keep"] == (got[i]["score"] >= 0.5)


# --- 7 ----------------------------------------------------------------------------------------------------------


def plain_toxicity(net: toxicity.Network, text: str | None) -> float:
    """The network's equations, a window, a word and a unit at a time."""
    p, h = net.p, toxicity.HIDDEN
    found = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    known = {int(x): k + 1 for k, x in enumerate(net.words)}

    def vector(word: str) -> np.ndarray:
        raw = word.encode()
        own = known.get(int(Words(*column_bytes(pa.array([word])), "alnum").hash[0]), 0)
        marked = [1, *raw, 2]
        chars = [p["H"][slot((marked[i] << 16) | (marked[i + 1] << 8) | marked[i + 2], toxicity.CHAR_BITS)] for i in range(len(raw))]
        return p["E"][own] + sum(chars) / math.sqrt(len(raw))

    vectors = [vector(w) for w in found]

    def states(xs: list[np.ndarray], d: str) -> list[np.ndarray]:
        now, out = np.zeros(h), []
        for x in xs:
            a, g = x @ p[f"W{d}"] + p[f"c{d}"], now @ p[f"U{d}"]
            z, r = 1 / (1 + np.exp(-(a[:h] + g[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + g[h : 2 * h])))
            new = np.tanh(a[2 * h :] + r * g[2 * h :])
            now = (1 - z) * new + z * now
            out.append(now)
        return out

    n, best = len(vectors), -1e9
    starts = [0] if n <= toxicity.WINDOW else sorted({min(s, n - toxicity.WINDOW) for s in range(0, n - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)})
    for s in starts:
        xs = vectors[s : s + toxicity.WINDOW]
        both = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        pooled = np.zeros(2 * h)
        if both:
            e = np.array([x @ p["v"] for x in both])
            att = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            pooled = sum(a * x for a, x in zip(att, both, strict=True))
        best = max(best, float(pooled @ p["o"] + p["k"][0]))
    return logistic(net.a * best + net.b)


def test_scores_are_those_of_the_network(spark):
    rng = random.Random(6)
    good = [words(rng, rng.randint(5, 90)) for _ in range(120)]
    bad = [f"{words(rng, rng.randint(0, 30))} zzbad {words(rng, rng.randint(0, 30))}" for _ in range(60)]
    net = toxicity.train(good + bad, [0] * 120 + [1] * 60, 0.3, epochs=6)
    texts = [None, "", "ZZBAD", "one", words(rng, 32), words(rng, 33), words(rng, 56), words(rng, 57), words(rng, 400), "É 中文 zzbad, x" * 20, "y" * 5000, *good[:10], *bad[:10]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in toxicity.score_toxicity(rows, net).collect():
        assert r["score"] == pytest.approx(plain_toxicity(net, texts[r["doc_id"]]), abs=2e-4), r["doc_id"]


def test_all_texts_empty():
    assert toxicity.train(["", "", "", ""], [0, 1, 0, 1], 0.5).scores(*column_bytes(pa.array(["", "x"]))).tolist() == [0.5, 0.5]


# --- 10 ---------------------------------------------------------------------------------------------------------


def test_marginals_against_all_labellings():
    """Exact on chains; on loops the messages stay near the exact marginals and decide alike."""
    model = pii.train(["call +1 555 123 4567 or a@b.cd", "mail x.y@z.org, ip 10.0.0.1", "+44 20 7946 0958 and 4111 1111 1111 1111"] * 40)
    texts = [
        "1234567 then 7654321 then 5550001", "+1 555 123 4567 or 555-123-4567", "+1 555 123 4567, 555 123 4567 and 123-4567",
        "me@host.org or me at host dot org", "4111 1111 1111 1111 is 4111.1111.1111.1111", "7654321 and a@b.cd and 7654321 and 7654321",
    ]
    for t in texts:
        nodes = pii.candidates(t, pii.base_spans(t))
        unary, edges = model.potentials(nodes)
        k = len(pii.KINDS) + 1
        exact = np.zeros((len(nodes), k))
        for labels in itertools.product(range(k), repeat=len(nodes)):
            weight = math.exp(sum(unary[i, x] - unary[i].max() for i, x in enumerate(labels)) + sum(float(w[labels[i], labels[j]]) for i, j, w in edges))
            for i, x in enumerate(labels):
                exact[i, x] += weight
        exact /= exact.sum(1, keepdims=True)
        got = model.marginals(nodes)
        loops = len(edges) >= len(nodes)
        assert np.abs(got - exact).max() < (0.12 if loops else 0.01), t
        assert (got.argmax(1) == exact.argmax(1)).all(), t


def test_fitting_rows_stay_bounded(spark):
    texts = [f"call +1 555 {i:03d} 4567" for i in range(1000)]
    for i in (0, 10, None):
        same = spark.createDataFrame([(i, t) for t in texts], "doc_id long, text string")
        sizes = []
        real = pii.train
        try:
            pii.train = lambda rows: sizes.append(len(rows)) or real(rows)
            pii.fit_spans(same, most_docs=100)
            pii.fit_spans(same.unionByName(same.limit(1).crossJoin(spark.range(3000)).select("doc_id", "text")), most_docs=100)
        finally:
            pii.train = real
        assert 50 < sizes[0] < 160
        assert sizes[1] < 160
