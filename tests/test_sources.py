from __future__ import annotations

import pytest

from graphloom.sources import files
from graphloom.streaming.resume import resume_stream


def test_edge_list_traps(spark, tmp_path):
    at = tmp_path / "e.tsv"
    at.write_text('A\tB\n#2\t2\n"Q\tR"\nÉ–1\tÉ–1\n')
    assert files.read_edges(spark, str(at)).count() == 3
    rows = {(r["a"], r["b"]) for r in files.read_edges(spark, str(at), comments=False).collect()}
    assert rows == {("A", "B"), ("#2", "2"), ('"Q', 'R"'), ("É–1", "É–1")}


def test_edge_without_name_fails(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("A\t \n")
    with pytest.raises(Exception, match="edge without a name"):
        files.read_edges(spark, str(tmp_path / "e.tsv")).collect()


def test_ids_and_jsonl(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r["id"] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    assert files.read_ids(spark, str(tmp_path / "ids.txt"), blanks=True).count() == 3
    (tmp_path / "x.jsonl").write_text('{"a": 1, "s": "\\u00e9"}\n{"a": \n')
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, s string", strict=False).collect()
    assert [(r["a"], r["s"]) for r in got] == [(1, "é"), (None, None)]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, s string").collect()


def test_images_skip_missing_shards(spark, tmp_path):
    (tmp_path / "01").mkdir()
    (tmp_path / "01" / "a.JPG").write_bytes(b"x")
    (tmp_path / "01" / "b.txt").write_bytes(b"y")
    got = files.encoded_images(files.read_images(spark, str(tmp_path / "01"), str(tmp_path / "02"))).collect()
    assert [(r["id"], r["ext"], r["b64"], r["mime"]) for r in got] == [("a", "jpg", "eA==", "image/jpeg")]
    assert files.read_images(spark, str(tmp_path / "03")).count() == 0


def test_checked_copies(spark):
    p = lambda *x: spark.createDataFrame([(y,) for y in x], "path string")
    assert files.checked_copies(p("a.jpg"), p("a.jpg", "b.png")).first()["n"] == 1
    with pytest.raises(Exception, match="not a required image"):
        files.checked_copies(p("c.jpg"), p("a.jpg")).collect()


def test_resume_appends_what_is_missing(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "id long, n long"
    step = lambda d: d.selectExpr("id", "id * 2 AS n")
    assert files.resume(spark, spark.range(3), out, "id", step, schema).count() == 3
    got = files.resume(spark, spark.range(5), out, "id", step, schema)
    assert sorted(r["n"] for r in got.collect()) == [0, 2, 4, 6, 8]


def test_stream_adds_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    step = lambda d: d.selectExpr("id", "id + 1 AS n")
    for hi in (3, 5):
        spark.range(hi).write.mode("append").parquet(src)
        resume_stream(spark.readStream.schema("id long").parquet(src), out, str(tmp_path / "ck"), "id", step, "id long, n long").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_cached_stage(spark, tmp_path):
    made = []
    for _ in range(2):
        n = files.cached_stage(spark, str(tmp_path / "s"), lambda: made.append(1) or spark.range(4)).count()
    assert n == 4
    assert len(made) == 1


def test_pairs_go_as_far_as_the_shorter_list(spark):
    ids = spark.range(5).selectExpr("id AS pos", "id + 10 AS id")
    vectors = spark.range(3).selectExpr("id AS pos", "array(id) AS embedding")
    assert sorted(r["id"] for r in files.paired_prefix(ids, vectors).collect()) == [10, 11, 12]


def test_copies_replace_the_folder(spark, tmp_path, monkeypatch):
    for n in ("a.jpg", "b.png", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.jpg").write_bytes(b"old")
    images = files.read_images(spark, str(tmp_path))
    got = {r["id"]: bytes(r["content"]) for r in files.copy_images(images, str(tmp_path / "out")).collect()}
    assert got == {"a": b"a.jpg", "b": b"b.png"}
    monkeypatch.setattr(files, "MOST_COPIES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        files.copy_images(images, str(tmp_path / "out"))


def test_what_is_missing_fails(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert [tuple(r) for r in files.required(a.limit(1), b, "k").collect()] == [(1, "x")]
    with pytest.raises(Exception, match="no k 2"):
        files.required(a, b, "k").collect()
    with pytest.raises(Exception, match="not of kind N"):
        files.checked_done(spark.createDataFrame([("x", "T")], "id string, kind string"), "id", "kind", "N").collect()
    named = lambda x: files.question_images(spark.createDataFrame([(x,)], "f string"), "f").first()["image_id"]
    assert named("/d/q1.JPG") == "q1"
    for bad in ("q1.txt", "a.b.jpg", "jpg", None):
        with pytest.raises(Exception, match="not an image"):
            named(bad)


def test_samples(spark):
    from graphloom.operators.sampling import sample_a_group, sample_rows

    rows = spark.range(20).selectExpr("id", "id % 3 AS g")
    assert {r["id"] for r in sample_rows(rows, "id", 5).collect()} == {r["id"] for r in sample_rows(rows.repartition(4), "id", 5).collect()}
    assert sample_a_group(rows, "g", "id", 2).count() == 6
    with pytest.raises(ValueError, match="fewer than 21"):
        sample_rows(rows, "id", 21)
