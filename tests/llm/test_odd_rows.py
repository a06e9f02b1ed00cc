"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import math
import random

import pytest
from conftest import CLASH, SCHEMA
from made_texts import words
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate as decontaminate_module
from graphloom.llm import mixing, quality, warc
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.langid import fit_languages, identify_languages
from graphloom.llm.licenses import scan_licenses
from graphloom.llm.mixing import mix_sources
from graphloom.llm.mtree import top_inner_products
from graphloom.llm.ngram_join import join_components
from graphloom.llm.pii import find_personal_data, fit_spans
from graphloom.llm.quality import OUTPUTS, classify_quality, fit_quality
from graphloom.llm.toxicity import fit_toxicity, score_toxicity
from graphloom.llm.warc import archive_pages

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((1, 0, 1), (4, 1, 0), (5, 1, 0), (6, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


def bench(spark, rows=((1, "a b c d e f g h i"), (None, "x y"), (2, None), (3, ""), (4, "same row"), (4, "same row"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def by_operator(spark, docs, some):
    marks = labels(spark) if some else labels(spark, [])
    items = bench(spark) if some else bench(spark, [])
    lang = fit_languages(docs, "text", F.col("lang"), F.col("doc_id"))
    q = fit_quality(docs, marks)
    return {
        1: mix_sources(docs),
        2: identify_languages(docs, lang),
        3: classify_quality(docs, q, F.col("source"), F.concat_ws("/", "source", "lang")),
        4: scan_licenses(docs),
        5: join_components(docs),
        7: score_toxicity(docs, fit_toxicity(docs, marks, F.lit(True))),
        8: decontaminate(docs, items),
        10: find_personal_data(docs, fit_spans(docs)),
    }


def test_odd_rows(spark, odd_docs):
    out = {k: v.collect() for k, v in by_operator(spark, odd_docs, True).items()}
    assert {len(v) for v in out.values()} == {odd_docs.count()}
    made = {2: {"lang_pred", "score", "ambiguous"}, 3: set(OUTPUTS), 4: {"n_words", "places"}, 7: {"score"}, 8: {"n_words", "hits", "items", "n_hit"}, 10: {"pii"}}
    for k, new in made.items():
        assert set(odd_docs.columns) | new == set(out[k][0].asDict()), k
        assert all(r[c] == "clash" for r in out[k] for c in CLASH if c not in new), k
    size = {r["doc_id"]: r["size"] for r in out[1]}
    assert (size[1], size[2], size[3], size[9]) == (0, 0, 0, 30_000)
    assert all(r["taken"] <= 3 * r["size"] for r in out[1])
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out[2]}
    assert pred[1] == pred[2] == pred[3] == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for k in (2, 3, 7) for r in out[k])
    assert {r["n_words"] for r in out[4] if r["doc_id"] in (1, 2, 3)} == {0}
    join = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out[5]}
    assert join[(1, 0)] == 1
    assert join[(4, 1)] == 4
    assert join[(9, 1)] == 9
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out[8]}
    assert hit[6] == (2, 2, ["4"])
    assert hit[1] == (0, 0, [])


def test_tables_too_large_to_send(spark, odd_docs, monkeypatch):
    """Whatever has a bound for being broadcast does the same without."""
    for module, name in ((quality, "MOST_SITES"), (decontaminate_module, "MOST_SENT"), (mixing, "MOST_SENT")):
        monkeypatch.setattr(module, name, 0)
    model = fit_quality(odd_docs, labels(spark))
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    for keep_text in (True, False):
        few, many = [], []
        for out, most in ((few, 50_000), (many, 0)):
            monkeypatch.setattr(quality, "MOST_SITES", most)
            out += sorted((repr((r["doc_id"], r["n_chars"], r["score"], r["keep"])) for r in classify_quality(odd_docs, model, host, path, keep_text=keep_text).collect()))
        assert few == many
    items = bench(spark, [(i, words(random.Random(i), 9)) for i in range(5)] + [(7, "same row"), (8, "w w w w w w w w")])
    want = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in decontaminate(odd_docs, items).collect())
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in decontaminate(odd_docs, items, chunk_windows=2).collect()) == want
    assert any("'8'" in x for x in want)
    mixed = sorted(repr(tuple(r)) for r in mix_sources(odd_docs).collect())
    monkeypatch.setattr(mixing, "MOST_SENT", 50_000)
    assert sorted(repr(tuple(r)) for r in mix_sources(odd_docs).collect()) == mixed


def test_empty_tables(spark, no_docs):
    for k, v in by_operator(spark, no_docs, False).items():
        assert v.count() == 0, k


def test_docs_without_labels_or_items(spark, odd_docs):
    out = by_operator(spark, odd_docs, False)
    assert all(r["keep"] for r in out[3].collect())
    assert {r["score"] for r in out[7].collect()} == {0.0}
    assert out[8].filter("n_hit > 0").count() == 0


def test_pages(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c d", None), (4, "filedesc://x", ""), (None, "http://e", "x"), (5, "http://f", "é" * 10), (2, None, "x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"keeper": F.lit(1), "key": F.lit(2), "value": F.lit("v")})
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive_pages(p).collect()), key=repr)
    assert got == sorted([(0, 1, "revisit", 2), (1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 20, "response", None)], key=repr)
    assert archive_pages(p.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc, "MOST_BROADCAST", 0)
        assert sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive_pages(p).collect()), key=repr) == got


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.5, 0.5]), (6, []), (None, [1.0, 1.0]), (7, [1.0]), (50, [None, 1.0]), (100, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("c"), "part": F.lit("c"), "q": F.lit(0)})
    got = [tuple(r) for r in top_inner_products(v, "vec_id", "embedding", F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 5, 32768), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 5, 0)]
    assert top_inner_products(v.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


@pytest.fixture
def tables(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, odd_docs, no_docs, tables):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tables)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == docs.count()


def test_repeated_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])] + [(1, [0.9, 0.1])] * 7 + [(i, [0.8 - i / 100, 0.2]) for i in range(2, 9)] + [(9, [0.7, 0.7])] * 2
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * a) for a in x]) for i, x in rows]
    want = []
    for q in (0, 50):
        s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in whole if i == q for j, y in whole if j != q)
        want += [(q, n, j, -p) for n, (p, j) in enumerate(s[:5], 1)]
    for tree_rows in (8192, 4):
        got = top_inner_products(v, "vec_id", "embedding", F.col("vec_id") % 50 == 0, tree_rows=tree_rows)
        assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == want


def test_near_duplicates_are_told_apart_by_row(spark):
    rng = random.Random(9)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (2, a.upper()), (3, c), (3, c), (3, c.upper()), (None, d), (None, d), (None, d + " x"), (None, b), (4, None), (4, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(4)
    for most in (corpus_pipeline.MOST_SENT, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(corpus_pipeline, "MOST_SENT", most)
            got = [(r["doc_id"], (r["text"] or "").lower()) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
        assert sorted(x for x in got if x[1] and x[1] not in (d, d + " x")) == sorted([(1, a), (2, b), (3, c)], key=lambda x: x[0])
        assert [i for i, t in got if t in (d, d + " x")] == [None]
        assert sorted(repr(i) for i, t in got if not t) == ["4", "4", "None", "None"]
