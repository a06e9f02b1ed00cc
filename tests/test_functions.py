from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import compare, models, text


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], names).select(column.alias("r")).first()["r"]


def S(x):
    return ("string", x)


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip("x"), x=S("\t a b\n")) == "a b"
    assert one(spark, text.entity_key("x"), x=S("\tPlasy\n")) == "PLASY"


@pytest.mark.parametrize(("path", "stem", "ext"), [("/a/b.c/x.tar.GZ", "x.tar", "gz"), (".hidden", ".hidden", ""), ("plain", "plain", ""), ("http://h/p.JPG", "p", "jpg")])
def test_paths(spark, path, stem, ext):
    assert one(spark, F.array(text.stem("x"), text.extension("x")), x=S(path)) == [stem, ext]


def test_ids_keep_long_numbers(spark):
    assert one(spark, text.part_id(F.lit("d"), "T", F.lit(7))) == "d:T007"
    assert one(spark, text.part_id(F.lit("d"), "T", F.lit(12345))) == "d:T12345"
    assert one(spark, text.natural_key("x"), x=S("N000012:T010")) == [12, 10]


@pytest.mark.parametrize(("t", "name", "hit"), [("the Art of x", "art", True), ("cart", "art", False), ("C++ is", "C++", False), ("a.b c", "A.B", True), ("q\\Ex", "q\\Ex", True)])
def test_has_word(spark, t, name, hit):
    assert one(spark, text.has_word("t", "n"), t=S(t), n=S(name)) is hit


@pytest.mark.parametrize(("a", "b", "hit"), [("24 DB", "2,4-DB", True), ("World Health Organization", "WHO", True), ("A", "A", False), ("ab", "cd", False)])
def test_acronyms(spark, a, b, hit):
    assert one(spark, text.is_acronym("a", "b"), a=S(a), b=S(b)) is hit


def test_fences(spark):
    fenced = "```json\n[1]\n```"
    assert one(spark, text.unfenced("x"), x=S(fenced)) == "[1]"
    assert one(spark, text.unfenced_block("x"), x=S(fenced)) == "json\n[1]"
    assert one(spark, text.lenient_json("x"), x=S('so: {"a": 1} end')) == '{"a":1}'
    assert one(spark, text.lenient_json("x"), x=S("nothing")) is None


def test_validators(spark):
    a = "array<string>"
    assert one(spark, text.nonblank_list("x"), x=(a, [])) is True
    assert one(spark, text.nonblank_list("x", 1), x=(a, [])) is False
    assert one(spark, text.nonblank_list("x"), x=(a, ["a", " \t"])) is False
    assert one(spark, text.nonblank_list("x"), x=(a, None)) is False
    assert one(spark, text.question_list("x"), x=(a, ["a? ", "b"])) is False
    assert one(spark, text.binary_grade("x"), x=S(" 1\n")) == 1
    assert one(spark, text.binary_grade("x"), x=S("2")) is None
    assert one(spark, text.rating("x"), x=S("I say 2 of 2")) == 1.0
    good = '[{"semantic_unit": "u", "entities": ["e"], "relationships": ["r"]}]'
    assert len(one(spark, text.decomposition("x"), x=S(good))) == 1
    assert one(spark, text.decomposition("x"), x=S('[{"semantic_unit": "u", "entities": []}]')) is None


@pytest.mark.parametrize(("answer", "score"), [("it is 5", 100.0), ("it is 3", 100.0), ("it is 30", 0.0), ("3 then 99", 0.0), ("none", 0.0)])
def test_number_score(spark, answer, score):
    assert one(spark, text.number_score("x", F.lit(5.0), F.lit(1.0), F.lit(9.0)), x=S(answer)) == score


def test_plain_answer(spark):
    assert one(spark, text.plain_answer("x"), x=S("The Élan-vital, of X")) == "elan vital x"
    assert one(spark, text.plain_answer("x"), x=S("the")) == ""
    assert one(spark, text.contained_score("a", "b"), a=S("anything"), b=S("the")) == 100.0


@pytest.mark.parametrize(("x", "plain"), [("Łódź", "lodz"), ("Кот", "kot"), ("Ærø straße", "aero strasse"), ("Ῥόδος", "rodos"), ("e\u0301te\u0301", "ete"), ("Đà Nẵng", "da nang"), ("щи-Борщ", "shchi borshch")])
def test_other_letters_are_spelled(spark, x, plain):
    assert one(spark, text.plain_answer("x"), x=S(x)) == plain


@pytest.mark.parametrize(("x", "image"), [("a.tiff", True), ("A.SVG", True), ("http://h/a.png?x=1#y", True), ("https://h/a.jpeg;v=1", True), ("http://x.jpg", False), ("d/a.gif?x", False), (".jpg", False), ("..jpg", False), ("a.b/c", False), ("", False), (None, None)])
def test_image_urls(spark, x, image):
    assert one(spark, text.is_image_url("x"), x=S(x)) is image


def test_videos(spark):
    a = "array<string>"
    for path, frames, video in (("any.txt", None, True), ("", None, True), (None, ["f.PNG", "x"], True), (None, ["x", "f.png"], False), (None, [], False), (None, None, False)):
        assert one(spark, text.is_video("p", "f"), p=S(path), f=(a, frames)) is video


def test_reference_answers(spark):
    answers = lambda x: one(spark, text.reference_answers("x"), x=S(x))
    got = answers('["a", 2, 2.5, {"wikidata": 7, "range": [6.5, 8]}, {"wikidata": 1, "range": [3]}]')
    assert [(r["text"], r["number"], r["value"], r["low"], r["high"]) for r in got] == [("a", None, None, None, None), (None, 2.0, None, None, None), (None, 2.5, None, None, None), (None, None, "7", "6.5", "8"), (None, None, "1", "3", "3")]
    assert one(spark, text.acceptable(text.reference_answers("x")), x=S('["a", 2]')) == "An acceptable answer is: a."
    for bad in ('[["a"]]', '[{"wikidata": 1}]', "[true]", '{"a": 1}', "no list"):
        with pytest.raises(Exception, match="neither a text|not a list"):
            answers(bad)


def test_ascii_json(spark):
    import json

    x = '{"s": "é 中 🙂 \\n"}'
    got = one(spark, text.escaped_json("x"), x=S(x))
    assert got.isascii()
    assert json.loads(got) == json.loads(x)
    assert "\\ud83d\\ude42" in got


def test_messages_of_contexts(spark):
    c = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s).alias("score"), F.lit(k).alias("type"), F.lit(x).alias("content"), F.lit(n).cast("string").alias("names")) for r, s, k, x, n in ((2, 0.4, "T", "low", None), (3, 0.9, "V", "i.png", "ANN"), (1, 0.5, "S", "text", None))])
    got = one(spark, text.message_text(text.context_messages(c, F.lit("why"), F.lit("q.png"))))
    assert got == "text=[CONTEXT]|text=---Context 1---|text=text|text=---Context 3---|text=This is an image of: ANN|image_url=i.png|text=[QUESTION]\nwhy|text=[QUESTION IMAGE]|image_url=q.png|text=[QUESTION]\nwhy"


def test_messages(spark):
    m = one(spark, text.embedding_message(F.lit("Do it"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert [p["text"] for p in m] == ["Do it.", "NULL"]
    assert one(spark, text.with_full_stop("x"), x=S("why?")) == "why?"
    assert one(spark, text.even_frames(F.sequence(F.lit(0), F.lit(9)), 4)) == [0, 3, 6, 9]
    assert one(spark, text.truncated_tokens(F.array(*map(F.lit, "abcSd")), F.array(F.lit("S")), 3)) == ["a", "b", "S"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    assert compare.common_subsequence(a, b) == lcs(a, b)
    assert 0 <= compare.partial_ratio(a, b) <= 100


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=9), st.text("abc ", max_size=20))
def test_partial_ratio_is_the_best_piece(a, b):
    short, long = sorted((a, b), key=len)
    pieces = [long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long)))]
    want = max((compare.ratio(short, p) for p in pieces), default=0.0) if short else (100.0 if not long else 0.0)
    assert compare.partial_ratio(a, b) == pytest.approx(want)


def test_ratios():
    assert compare.partial_ratio("art", "cartoon") == 100.0
    assert compare.token_set_ratio("a b", "b a c") == 100.0
    assert compare.rouge_l("the cats ran", "the cat runs") == pytest.approx(2 / 3)
    assert compare.rouge_l("", "x") == 0.0
    assert [compare.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "adjustable")] == ["caress", "poni", "relat", "hop", "happi", "adjust"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), min_size=1, max_size=30), max_size=12))
def test_chunks_bounded_and_whole(lines):
    t = "\n".join(" ".join(f"w{x}." for x in line) for line in lines)
    for c in compare.chunks_of(t, 5, 20, 4, faithful=False):
        assert 0 < len(c.split()) < 20 + 20 + 30
    lost = {w for w in t.split()} - {w for c in compare.chunks_of(t, 5, 20, 4, faithful=False) for w in c.split()}
    assert not lost


def test_short_lines_go_both_ways():
    assert compare.paragraphs("a b c\nd\ne f g", 3) == ["a b c\nd", "d\ne f g"]
    assert compare.paragraphs("a", 3) == ["a"]


@pytest.mark.parametrize(
    ("lines", "packed"),
    [
        ("", []),
        ("\n \n", []),
        ("a\n\nb", ["a\n\nb"]),  # a blank line stays where something waits for it
        ("a\n", ["a\n"]),
        ("a b c", ["a b c"]),
        ("a b c\n\nd e f", ["a b c", "d e f"]),
        ("a b c\nd\ne\nf", ["a b c\nd\nd\ne", "d\ne\nf"]),  # what is too short ends the paragraph before, anew with every line
        ("a b c\nd\n\n", ["a b c\nd\nd\n\nd\n\n"]),
        ("a\nb c d e\nf g h", ["a\nb c d e", "f g h"]),
    ],
)
def test_packed_lines(lines, packed):
    assert compare.paragraphs(lines, 3) == packed


@pytest.mark.parametrize(
    ("faithful", "chunks"),
    [
        # Under six words a chunk, two carried over: "f g." doesn't fit and is lost; "h." and "i j." follow what was carried.
        (True, ["a b. c d. e.", "c d. e. h.", "e. h. k l."]),
        (False, ["a b. c d. e.", "c d. e. f g.", "f g. h. i j.", "i j. k l."]),
    ],
)
def test_windows_of_sentences(faithful, chunks):
    p = "a b. c d. e. f g. h. i j. k l."
    assert compare.sentence_windows(p, 6, 2, faithful) == chunks
    assert compare.sentence_windows("a b c d e f g h. i.", 6, 2, True) == ["", "i."]  # a sentence that is too long leaves an empty chunk
    assert compare.sentence_windows("a b", 6, 2, True) == ["a b"]


def test_judges_parse_their_prompts():
    import json

    ask = lambda f, task, **parts: json.loads(f(models.PROMPTS[task].format(**parts))[0])
    assert ask(models.stand_in_statements, "statements", text="One is. Two?\nThree") == ["One is.", "Two?", "Three"]
    assert ask(models.stand_in_correctness, "correctness", text='["a", "b"]', gold='["b", "c"]') == {"TP": ["b"], "FP": ["a"], "FN": ["c"]}
    assert [v["verdict"] for v in ask(models.stand_in_verdicts, "attribution", question="q", context="the A b", statements='["a B", "c"]')] == [1, 0]
    assert models.stand_in_rating(models.PROMPTS["relevance"].format(question="b a", context="a b c"))[0] == "2 of 2"


def test_retry():
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise ValueError("no")
        return "1", 2

    assert models.call_with_retry(flaky, "p", models.Retry(attempts=5)) == ("1", 2, 3, None)
    assert models.call_with_retry(lambda p: ("bad", 1), "p", models.Retry(attempts=2, failure="fallback", fallback="x"), lambda s: s == "1")[:3] == ("x", 2, 2)
    with pytest.raises(RuntimeError):
        models.call_with_retry(lambda p: ("bad", 1), "p", models.Retry(attempts=1, failure="raise"), lambda s: False)


def test_known_answers_are_not_asked(spark):
    df = spark.createDataFrame([(1, "Ask Me", None), (2, "no", "kept")], "id int, q string, k string")

    def make():
        def call(p):
            if p == "no":
                raise AssertionError
            return p.upper(), 1

        return call

    out = {r["id"]: r["text"] for r in models.answered(df, F.col("q"), make, known=F.col("k")).collect()}
    assert out == {1: "ASK ME", 2: "kept"}
