"""Judgements by models and the metrics over them. Each takes rows (qid and the texts that it names) and a hook for every model call; stand-ins by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import models, text
from graphloom.functions.models import Retry, answered, prompt
from graphloom.operators.evaluate import answer_accuracy

VERDICTS = "array<struct<statement:string,verdict:int>>"
AGAIN = Retry(attempts=10)


def _blank(x: str) -> Column:
    return F.length(text.strip(F.coalesce(F.col(x), F.lit("")))) == 0


def _asked(rows: DataFrame, name: str, task: Column, make, valid=None, known: Column | None = None) -> DataFrame:
    """Adds the model's text under a name of its own."""
    out = answered(rows.withColumn("_asked", task), F.col("_asked"), lambda: make, AGAIN, valid, known)
    return out.withColumn(name, F.col("text")).drop("_asked", "text", "tokens", "attempts", "error")


def statements_of(rows: DataFrame, source: str, name: str, task: str = "statements", make=models.stand_in_statements) -> DataFrame:
    """Adds the statements of a text, a JSON list."""
    parts = {"text": F.col(source)} | ({"question": F.col("question")} if "{question}" in models.PROMPTS[task] else {})
    return _asked(rows, name, prompt(task, **parts), make)


def judged_accuracy(rows: DataFrame, similarity: Column, make=models.stand_in_correctness) -> DataFrame:
    """(qid, tp, fp, fn, accuracy) of answers against references (answer, gold), statement by statement."""
    both = statements_of(statements_of(rows.withColumn("_similarity", similarity), "answer", "mine"), "gold", "theirs")
    out = _asked(both, "sorted", prompt("correctness", text=F.col("mine"), gold=F.col("theirs")), make)
    out = out.withColumn("s", F.from_json("sorted", "TP array<string>, FP array<string>, FN array<string>"))
    tp, fp, fn = (F.coalesce(F.size(f"s.{k}"), F.lit(0)) for k in ("TP", "FP", "FN"))
    return out.select("qid", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), answer_accuracy(tp, fp, fn, F.col("_similarity")).alias("accuracy"))


def _share(rows: DataFrame, judged: str) -> Column:
    """Mean verdict; null where nothing could be judged."""
    v = F.from_json(judged, VERDICTS)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x["verdict"]) / F.size(v))


def judged_recall(rows: DataFrame, make=models.stand_in_verdicts) -> DataFrame:
    """(qid, context_recall): 1 if a statement of the reference (gold) can be attributed to the context; a blank reference counts 1, a blank context 0."""
    known = F.when(_blank("gold"), "[{\"verdict\":1}]").when(_blank("context"), "[{\"verdict\":0}]")
    out = statements_of(rows, "gold", "said")
    out = _asked(out, "judged", prompt("attribution", question=F.col("question"), context=F.col("context"), statements=F.col("said")), make, known=known)
    return out.select("qid", (F.coalesce(_share(out, "judged"), F.lit(0.0)) > 0).cast("int").alias("context_recall"))


def judged_coverage(rows: DataFrame, make=models.stand_in_verdicts) -> DataFrame:
    """(qid, coverage): share of the reference's facts that the context covers; 1 for a blank reference."""
    out = statements_of(rows, "gold", "said", "facts")
    out = _asked(out, "judged", prompt("fact_coverage", context=F.col("context"), statements=F.col("said")), make, known=F.when(_blank("gold"), "[{\"verdict\":1}]"))
    return out.select("qid", _share(out, "judged").alias("coverage"))


def judged_faithfulness(rows: DataFrame, make=models.stand_in_verdicts) -> DataFrame:
    """(qid, faithfulness): share of the answer's statements that the context supports; 1 for a blank answer, 0 for a blank context."""
    known = F.when(_blank("answer"), "[{\"verdict\":1}]").when(_blank("context"), "[{\"verdict\":0}]")
    out = statements_of(rows, "answer", "said", "faithful_statements")
    out = _asked(out, "judged", prompt("faithfulness", context=F.col("context"), statements=F.col("said")), make, known=known)
    return out.select("qid", _share(out, "judged").alias("faithfulness"))


def judged_relevance(rows: DataFrame, make=models.stand_in_rating) -> DataFrame:
    """(qid, relevance): the mean of two ratings of 0 to 2, halved; 0 without question or context, or where they are the same."""
    known = F.when(_blank("question") | _blank("context") | (F.col("question") == F.col("context")), "0")
    asked = prompt("relevance", question=F.col("question"), context=F.col("context"))
    out = _asked(_asked(rows, "first", asked, make, known=known), "second", asked, make, known=known)
    ratings = F.array_compact(F.array(text.rating("first"), text.rating("second")))
    return out.select("qid", F.when(F.size(ratings) > 0, F.aggregate(ratings, F.lit(0.0), lambda s, x: s + x) / F.size(ratings)).alias("relevance"))


def graded(rows: DataFrame, fuzzy: str, make=models.stand_in_grade) -> DataFrame:
    """(qid, score, asked): 1 where the fuzzy score (0 to 100) says so; else a judge is asked, and a second time where it first says 0. asked: how often."""
    valid = lambda s: s.strip() in ("0", "1")
    task = prompt("grade", gold=F.col("gold"), text=F.col("answer"))
    sure = F.when(F.col(fuzzy) >= 95, "1")
    first = _asked(rows, "first", task, make, valid, sure)
    second = _asked(first, "second", task, make, valid, F.when(F.trim("first") == "1", F.lit("1")))
    asked = F.when(F.col(fuzzy) >= 95, 0).when(F.trim("first") == "1", 1).otherwise(2)
    return second.select("qid", F.coalesce(text.binary_grade("second"), F.lit(0)).alias("score"), asked.alias("asked"))
