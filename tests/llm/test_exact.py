"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from made_texts import words
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import langid, licenses, mtree, ngram_join, pii, toxicity, warc
from graphloom.llm.common import Words, column_bytes
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.mixing import mix_sources
from graphloom.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_are_those_of_the_patterns():
    import pyarrow as pa

    texts = ["Ab-c d_e", "", "É x\tY Z\x0b", None, " a ", "中文 ok"]
    raw, off = column_bytes(pa.array(texts))
    for kind, rule in (("alnum", WORD), ("space", SPACE)):
        w = Words(raw, off, kind)
        for i, t in enumerate(texts):
            own = [raw[a:b].tobytes().decode().translate(FOLD) for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            assert own == rule.findall((t or "").translate(FOLD))
    a = Words(*column_bytes(pa.array(["HELLO x"])), "alnum").hash
    b = Words(*column_bytes(pa.array(["y hello"])), "alnum").hash
    assert a[0] == b[1]


# --- 1 ----------------------------------------------------------------------------------------------------------


def test_mix_targets_by_hand(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (1000, "b"), (3000, "c"), (50, None)])], "doc_id long, text string, source string")
    got = {r["source"]: r for r in mix_sources(docs).collect()}
    # 4150 words; weights 5, 2, 1, 5: a and null stop at 300 and 150, the rest by 2 and 1: b would get 2466.7 and c 1233.3.
    assert [round(got[s]["target"], 1) for s in ("a", "b", "c", None)] == [300.0, 2466.7, 1233.3, 150.0]
    assert sum(r["target"] for r in got.values()) == pytest.approx(4150)


def test_mix_hits_its_targets_whatever_the_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice("aaaaabcd")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = {r["doc_id"]: tuple(r) for r in mix_sources(docs.repartition(2)).collect()}
    b = {r["doc_id"]: tuple(r) for r in mix_sources(docs.repartition(7)).collect()}
    assert a == b
    for s in "abcd":
        own = [r for r in a.values() if r[1] == s]
        assert abs(sum(r[5] for r in own) - own[0][4]) <= 0.02 * own[0][4] + 64
    assert all(r[5] <= 3 * r[2] for r in a.values())


def test_permutation(spark):
    from graphloom.llm.mixing import with_permuted

    for n in (1, 2, 3, 15, 255, 1000):
        got = {}
        for key in (3, 4):
            rows = with_permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("long"), F.lit(key)).orderBy("id").collect()
            got[key] = [r["p"] for r in rows]
            assert sorted(got[key]) == list(range(n))
        if n > 100:
            moves = {(b - a) % n for a, b in zip(got[3], got[3][1:], strict=False)}
            assert len(moves) > n / 3  # no rotation, no multiple
            assert sum(a == b for a, b in zip(got[3], got[4], strict=True)) < 12


# --- 2, 3, 7 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 4, 5, 9])
def test_codewords_differ(n):
    m = langid.code_matrix(n)
    assert min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= min(2 ** (n - 2), 3)
    assert ((m.sum(0) > 0) & (m.sum(0) < n)).all()


def test_language_of_held_out_rows(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = QUERIES["op2_language_id"](spark, sf).filter("held_out").collect()
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_quality_of_held_out_rows(spark, sf):
    from graphloom.llm.quality import classify_quality, fit_quality

    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_quality(docs, labels.filter("doc_id % 2 = 0"))
    got = classify_quality(docs, model, F.col("source"), F.col("lang")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(bool(r["quality"]) == r["keep"] for r in got) >= 0.95 * len(got)


def test_sparse_sites_shrink(spark):
    from graphloom.llm.quality import site_posteriors

    sums = spark.createDataFrame([("big", "big/a", 900, 90.0), ("big", "big/b", 1, 1.0), ("one", "one/a", 1, 0.0)], "host string, path string, n long, total double")
    got = {r["path"]: (r["host_posterior"], r["path_posterior"]) for r in site_posteriors(sums, 0.8).collect()}
    assert got["big/a"][1] < got["big/b"][1]
    assert got["one/a"][0] > got["big/a"][0]


def test_gradients():
    rng = np.random.default_rng(0)
    p = toxicity._init(rng)
    p |= {"E": rng.normal(0, 0.5, (6, toxicity.DIM)), "H": rng.normal(0, 0.5, (5, toxicity.DIM))}
    forms = toxicity.Forms(np.arange(3, dtype=np.uint64), rng.integers(0, 5, 7), np.array([2, 4, 1]))
    ids, at = rng.integers(0, 6, (4, 3)), rng.integers(0, 3, (4, 3))
    mask = np.arange(4)[:, None] < np.array([4, 2, 1])[None, :]
    y, weight = np.array([1.0, 0.0, 1.0]), np.full(3, 1 / 3)
    run = lambda: toxicity._gradients(p, p["E"][ids] + forms.sums(p["H"])[at], ids, at, forms, mask, y, weight)
    _, g = run()
    for k in ("E", "H", "Wf", "Ub", "cf", "v", "o", "k"):
        flat = p[k].reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            keep, eps = flat[i], 1e-5
            flat[i] = keep + eps
            up = run()[0]
            flat[i] = keep - eps
            down = run()[0]
            flat[i] = keep
            assert g[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7)


def test_toxic_words_are_learned_and_windows_cover_the_text():
    rng = random.Random(4)
    good = [words(rng, rng.randint(5, 120)) for _ in range(300)]
    bad = []
    for t in good[:150]:
        w = t.split()
        w.insert(rng.randrange(len(w)), "zzbad")
        bad.append(" ".join(w))
    net = toxicity.train(good + bad, [0] * 300 + [1] * 150, 0.3)
    import pyarrow as pa

    fresh = [words(rng, 90) for _ in range(40)]
    marked = [" ".join([*t.split()[:k], "zzbad", *t.split()[k:]]) for k, t in zip(range(0, 80, 2), fresh, strict=True)]
    a, b = net.scores(*column_bytes(pa.array(fresh))), net.scores(*column_bytes(pa.array(marked)))
    assert (b >= 0.7).mean() > 0.9
    assert (a < 0.7).mean() > 0.9
    doc, start, length = toxicity.windows_of(np.array([0, 0, 5, 105]))
    assert doc.tolist()[:2] == [0, 1]
    assert sorted({s + i for d, s, n in zip(doc, start, length, strict=True) if d == 2 for i in range(n)}) == list(range(5, 105))


def test_toxicity_of_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op7_toxicity"](spark, sf).filter("held_out").collect() if r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held) >= 0.9 * len(held)


# --- 4 ----------------------------------------------------------------------------------------------------------


def test_license_places(spark):
    texts = [
        "MIT license, the MIT  License; mit-license", "mit x license", "GNU General Public License version 3", "Licensed under the Apache License, Version 2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "", "public license general", "Redistribution and use in source and binary forms are nice", "mİt lİcense",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t.translate(FOLD))
        base = sorted((j, label) for label, p in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])) for j in range(len(w)) if w[j : j + len(p)] == p)
        assert got[i]["n_words"] == len(w)
        assert sorted((p["start"], p["label"]) for p in got[i]["places"] if p["base"]) == base
    labels = lambda i: {p["label"] for p in got[i]["places"]}
    assert labels(2) == {"gpl", "gpl-3.0"}
    assert labels(3) == {"apache", "apache-2.0"}
    assert labels(4) == {"mit"}
    assert labels(7) == {"bsd"}


# --- 5 ----------------------------------------------------------------------------------------------------------


def components(texts: dict[int, str], width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = SPACE.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[j : j + min(width, len(w))]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    p, q = top(a), top(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_texts(seed: int, group: int) -> dict[int, str]:
    rng = random.Random(seed)
    texts, base = {}, words(rng, 90).split()
    passage = words(rng, 50)
    for i in range(group):  # near copies, some beyond the threshold, some only linked through others
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 6))):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts[i] = " ".join(w)
    for i in range(group, group + 60):
        texts[i] = f"{words(rng, rng.randint(1, 30))} {passage} {words(rng, rng.randint(1, 30))}"
    for i in range(group + 60, group + 120):
        texts[i] = words(rng, rng.randint(0, 14), "ab")
    for i in range(group + 120, group + 150):
        texts[i] = texts[rng.randrange(group)].upper()
    return texts


@pytest.mark.parametrize(("seed", "group", "rule"), [(1, 20, ngram_join.Rule()), (2, 300, ngram_join.Rule()), (3, 120, ngram_join.Rule(5, 80)), (4, 100, ngram_join.Rule(digest_bits=6))])
def test_join_is_exact(spark, monkeypatch, seed, group, rule):
    """Also where most sets share the digest that names them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    texts = near_texts(seed, group)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, rule=rule).collect()}
    assert got == components(texts, rule.width, rule.percent)


def test_join_of_a_passage_that_unrelated_texts_are_made_of(spark, monkeypatch):
    """Texts that share their rare lists with a centre that few of them link to, some of which link to each other."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    met, search = [], ngram_join.ring_links
    monkeypatch.setattr(ngram_join, "ring_links", lambda *a: met.append(1) or search(*a))
    rng = random.Random(9)
    passages = [words(rng, 40) for _ in range(6)]
    texts = {}
    for i in range(240):
        own = words(rng, rng.randint(3, 12)) if i < 160 else " ".join(texts[rng.randrange(160)].split()[40:])
        texts[i] = f"{passages[i % 6]} {own}"
    for i in range(240, 300):  # two passages: lists of unrelated groups meet in one text
        texts[i] = f"{passages[i % 6]} {passages[(i + 1) % 6]} {words(rng, rng.randint(1, 8))}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect()}
    assert got == components(texts, 4, 85)
    assert met
    assert 20 < len({c for _, c in got.values()}) < 280


def test_rings_of_links_are_adjacent():
    rng = np.random.default_rng(3)
    for rule in (ngram_join.Rule(), ngram_join.Rule(5, 80), ngram_join.Rule(4, 40)):
        base = set(range(60))
        sets = [base ^ set(rng.choice(90, rng.integers(0, 30), replace=False).tolist()) for _ in range(60)]
        ring = lambda a, b, rule=rule: rule.ring(len(a), len(b), len(a & b))
        for a in sets:
            for b in sets:
                assert (ring(a, b) == 0) == rule.links(len(a), len(b), len(a & b))
                if ring(a, b) == 0:
                    assert all(abs(ring(a, c) - ring(b, c)) <= 1 for c in sets)


def test_divide_skip():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(50)]
    flat, own = np.concatenate(sets), np.repeat(np.arange(50), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    for need in (1, 5, 12, 20):
        got = ngram_join.divide_skip(sets[0], flat[new], np.append(new, len(flat)), own, sets, need)
        assert sorted(got.tolist()) == [i for i, s in enumerate(sets) if len(np.intersect1d(s, sets[0])) >= need]


# --- 6 ----------------------------------------------------------------------------------------------------------


def test_arc_versions():
    for v in (1, 2):
        body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhello\n\nworld"
        data = warc.arc_version_block(v, "f.arc", "19990102030405") + warc.arc_member(v, "http://a b/c", "1999010203", body) + warc.arc_member(v, "dns:x", "19990102", b"1.2.3.4", kind="text/dns")
        head, page, dns = warc.parse_arc(data)
        assert head.fields["url"] == "filedesc://f.arc"
        assert page.fields["url"] == "http://a b/c"
        assert page.body == body
        (h, block), = warc.parse_warc(warc.convert(page) + b"\r\n\r\n")
        assert (h["warc-type"], h["warc-date"], block) == ("response", "1999-01-02T03:00:00Z", body)
        assert h["warc-payload-digest"] == "sha1:" + warc.digest32(b"hello\n\nworld")
        (h, block), = warc.parse_warc(warc.convert(dns))
        assert (h["warc-type"], block) == ("resource", b"1.2.3.4")
        (h, _), = warc.parse_warc(warc.convert(head))
        assert h["warc-type"] == "warcinfo"
    for broken in (b"x 0.0.0.0 1 t 3\nabc", warc.arc_version_block(1, "f", "1999") + b"\nhttp://a 0 1 t 99\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


def test_archives_are_bounded_and_revisits_name_their_record(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i % 9} " + "é" * (40 * (i % 9))) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"), file_bytes=4000)
    records, files = {}, 0
    for r in spark.read.format("binaryFile").load(str(tmp_path / "w")).collect():
        files += 1
        whole = b"".join(warc.pieces(bytes(r["content"])))
        own = list(warc.parse_warc(whole))
        monkeypatch.setattr(warc, "PIECE", 7)
        assert list(warc.parse_warc(warc.pieces(bytes(r["content"])))) == own
        assert list(warc.parse_warc(warc.pieces(whole))) == own
        monkeypatch.undo()
        assert sum(len(b) for _, b in own) <= 4000
        assert own[0][0]["warc-type"] == "warcinfo"
        for h, block in own:
            if h["warc-type"] != "warcinfo":
                records[int(re.search(rb"X-Page-Id: (\d+)", block)[1])] = h
    assert files > 5
    assert set(records) == set(range(60))
    for i, h in records.items():
        keeper = max(j for j in range(60) if j % 9 == i % 9)
        assert h["warc-type"] == ("response" if i == keeper else "revisit")
        if i != keeper:
            assert (h["warc-refers-to"], h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) == (records[keeper]["warc-record-id"], f"http://h/{keeper}", records[keeper]["warc-date"])
    with pytest.raises(ValueError, match="without end"):
        list(warc.pieces(gzip.compress(b"x" * 5000)[:-9]))


# --- 8 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [3, 200_000])
def test_occurrences(spark, chunk):
    rng = random.Random(6)
    tiny = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = {i: tiny(rng.randint(0, 60)) for i in range(60)} | {99: "A-B;c " * 400}
    items = {i: tiny(n) for i, n in enumerate([1, 2, 5, 8, 9, 12, 20, 0])}
    items[9] = items[5]
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(d, b, chunk_windows=chunk).collect()}
    for i, t in docs.items():
        w = WORD.findall(t.translate(FOLD))
        hit, found = set(), set()
        for k, x in items.items():
            v = WORD.findall(x.translate(FOLD))
            m = min(8, len(v))
            for j in range(len(v) - m + 1 if v else 0):
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[j : j + m]:
                        hit |= set(range(a, a + m))
                        found.add(str(k))
        assert got[i] == (len(w), len(hit), sorted(found))


# --- 9 ----------------------------------------------------------------------------------------------------------


def test_tree_is_exact():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.normal(0, 1, (900, 8)), np.tile(rng.normal(0, 1, (1, 8)), (400, 1))]))
    ids = rng.permutation(len(x)).astype(np.int64)
    tree = mtree.MTree(ids, x, float((x * x).sum(1).max()) + 5)
    for q in (0, 5, 1000):
        s = (x @ x[q]).astype(np.int64)
        want = sorted((-int(v), int(i)) for v, i in zip(s, ids, strict=True) if i != ids[q])[:5]
        near = lambda k, *least, q=q: [(-v, i) for v, i in tree.nearest(x[[q]], ids[[q]], k, np.array([*least, -np.inf][:1]))[0]]
        assert near(5) == want
        assert near(5, float(-want[2][0])) == [w for w in want if w[0] <= want[2][0]]
    both = tree.nearest(x[[0, 1000]], ids[[0, 1000]], 3, np.full(2, -np.inf))
    assert both == [tree.nearest(x[[q]], ids[[q]], 3, np.full(1, -np.inf))[0] for q in (0, 1000)]


@pytest.mark.parametrize("kind", ["groups", "even", "large"])
def test_search_over_cells_is_exact(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (600, 6))
    if kind == "groups":
        x = np.repeat(rng.normal(0, 1, (12, 6)), 50, axis=0) + rng.normal(0, 0.02, (600, 6))
    if kind == "large":
        x = x * 3e5
    x[300:420] = x[300]  # copies, more than a tree takes
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (30, 4)))]
    met, onward = [], mtree._onward
    monkeypatch.setattr(mtree, "_onward", lambda *a: met.append(onward(*a)) or met[0])
    monkeypatch.setattr(mtree, "CELL_ROWS", 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = mtree.top_inner_products(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, tree_rows=30, block_queries=4)
    whole = {i: [int(np.floor(256 * a)) for a in v] for i, v in rows}
    want = []
    for q, y in whole.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(y, v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(y))[:5]
            want += [(q, n, i, -score) for n, (score, i) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    if kind == "groups":  # most trees are out of reach
        assert met[0].count() < 0.5 * 12 * 600 / 30


# --- 10 ---------------------------------------------------------------------------------------------------------

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(t: str) -> list[tuple[int, int, int]]:
    out = []
    for k, rule in enumerate(PATTERNS):
        for m in rule.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_as_stated():
    rng = random.Random(8)
    pieces = ["a@b.c", "@", ".", "-", "+", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", " ", "x", "é", "_", "%", "(", ")", "a.b@c-d.e.f", "0", "00"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_repeats_are_found_and_base_stays():
    texts = [f"call +1 (555) 123-45{i:02d} or mail a{i}@b.com and 4111 1111 1111 1111 from 10.0.0.{i} at 1234567 8" for i in range(40)]
    model = pii.train(texts)
    t = "Write to jo.doe@mail.example.com or +1 (555) 123-4567. Again: JO.DOE at mail.example.com, 555 123 4567; not 555 123 4568."
    base, more = pii.find_spans(t, model)
    assert base == plain_spans(t)
    assert {t[s:e] for s, _, e in more} == {"JO.DOE at mail.example.com", "555 123 4567"}
    assert pii.find_spans("no data 12345678 here", model) == ([], [])
    red = pii.redacted(t, sorted([(*s, True) for s in base] + [(*s, False) for s in more]))
    assert "555" not in red.replace("555 123 4568", "")
    assert "<EMAIL>" in red


def test_similar_numbers_and_texts_without_base():
    texts = [f"call +1 (555) 123-45{i:02d} or mail a{i}@b.com and 4111 1111 1111 1111 from 10.0.0.{i} at 1234567 8" for i in range(40)]
    model = pii.train(texts)
    for one, other in (
        ("+33 6 12 34 56 78", "06 12 34 56 78"), ("+33 (0)6 12 34 56 78", "06 12 34 56 78"), ("+34 612 345 678", "612 345 678"), ("+123 45 678 901 234", "45 678 901 234"),
        ("+12 345 678 901 234 5", "345 678 901 234 5"), ("+1 555 123 4567", "1.555.123.4567"), ("+1 555 123 4567", "123-4567"),
    ):
        for t in (f"{one} or {other}; {other}, not 98 76 54 32 10", f"{other}, {other} is {one}, not 98 76 54 32 10"):
            more = pii.find_spans(t, model)[1]
            assert [(t[s:e].strip(), k) for s, k, e in more] == [(other, 3)] * 2, t
    found = lambda t: [(t[s:e], pii.KINDS[k]) for s, k, e in pii.find_spans(t, model)[1]]
    assert found("pay with 4111.1111.1111.1111 now") == [("4111.1111.1111.1111", "card")]
    assert found("ask jo1 [@] mail.example.com now") == [("jo1 [@] mail.example.com", "email")]
    for t in ("thanks @john.doe", "look at example.com, look at example.com", "version 1.555.123.4567", "4111 1111 1111 1111 is not 1111 1111", "5551234567 and 2121234567", "1234567 1234567 1234567"):
        assert found(t) == [], t


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    step = [dict(docs)]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), now.schema)
        step.append({r["doc_id"]: r.asDict() for r in now.collect()})
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all((i in step[1]) == bool(q) for i, q in quality.items() if i in docs)
    comp = components({i: r["text"] for i, r in step[1].items()}, 5, 80)
    assert set(step[2]) == {i for i, (_, c) in comp.items() if c == i}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall(r["text"].translate(FOLD))
        windows |= {tuple(w[j : j + min(8, len(w))]) for j in range(max(0, len(w) - 8) + 1) if w}
    sizes = {len(x) for x in windows}
    clean = {i for i, r in step[2].items() if not any(tuple(w[j : j + k]) in windows for w in [WORD.findall((r["text"] or "").translate(FOLD))] for k in sizes for j in range(len(w) - k + 1))}
    assert set(step[3]) == clean
    assert set(step[4]) == clean
    assert not any(pii.base_spans(r["text"] or "") for r in step[4].values())
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == {i: len(SPACE.findall(r["text"] or "")) for i, r in step[4].items()}


def test_digest_columns(spark, sf):
    got = QUERIES["op10_personal_data"](spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got:
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(text[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
