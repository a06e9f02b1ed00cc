"""Grades, recall and the comparison of variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    p, r = tp / (tp + fp + 1e-10), tp / (tp + fn + 1e-10)
    return (1 + beta**2) * p * r / (beta**2 * p + r + 1e-10)


def weighted(a: Column, b: Column, wa: float = 0.75, wb: float = 0.25) -> Column:
    return (a * wa + b * wb) / (wa + wb)


def answer_accuracy(tp: Column, fp: Column, fn: Column, similarity: Column) -> Column:
    """Three parts facts, one part similarity; without statements on either side the facts count as 1."""
    return weighted(F.when(tp + fp + fn == 0, 1.0).otherwise(f_beta(tp, fp, fn)), similarity)


def share_of(verdicts: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): mean of 0/1 verdicts; recall of statements, coverage of facts and faithfulness are this."""
    return verdicts.groupBy(key).agg(F.avg("verdict").alias(name))


def context_recall(attributed: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, context_recall): 1 for a blank answer, 0 for blank context, else whether any statement is attributed. A missing mean counts as 0."""
    mean = share_of(attributed, "qid", "mean")
    rows = answers.join(mean, "qid", "left")
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    return rows.select("qid", F.when(blank("answer"), 1).when(blank("context"), 0).otherwise(F.coalesce(F.col("mean") > 0, F.lit(False)).cast("int")).alias("context_recall"))


def context_relevance(ratings: DataFrame) -> DataFrame:
    """(qid, relevance): two ratings of 0 to 2, halved and averaged; 0 where the context is the question."""
    return ratings.select("qid", F.when(F.col("context") == F.col("question"), 0.0).otherwise((F.col("r1") / 2 + F.col("r2") / 2) / 2).alias("relevance"))


def accuracy(grades: DataFrame) -> DataFrame:
    return grades.filter(F.col("score").isin(0, 1)).agg(F.sum("score").alias("correct"), F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("accuracy"))


def recall_means(rows: DataFrame) -> DataFrame:
    kept = rows.filter(F.col("context_recall").isNotNull() & ~F.isnan(F.col("context_recall").cast("double")))
    return kept.agg(F.round(F.avg("context_recall"), 6).alias("recall"), F.round(F.avg("tokens"), 6).alias("tokens"), F.count(F.lit(1)).alias("n"))


def earlier_success(questions: DataFrame, *earlier: DataFrame) -> DataFrame:
    """(qid, score): 1 where an earlier variant (qid, score) solved the question, tried in turn; else null, to be judged."""
    rows = questions.select("qid")
    for i, e in enumerate(earlier):
        rows = rows.join(e.filter("score = 1").select("qid", F.lit(1).alias(f"s{i}")).distinct(), "qid", "left")
    return rows.select("qid", F.coalesce(*[F.col(f"s{i}") for i in range(len(earlier))]).alias("score"))


def solved(flags: dict[str, list[DataFrame]]) -> DataFrame:
    """(variant, solved): number of questions that any of a variant's tables (qid) names."""
    rows = [reduce(DataFrame.unionByName, [t.select("qid") for t in tables]).distinct().withColumn("variant", F.lit(v)) for v, tables in flags.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("variant").agg(F.count(F.lit(1)).alias("solved"))


def unsolved_report(questions: DataFrame, done: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, gold, contexts) of questions without success whose answer is not just a number."""
    left = questions.join(done.select("qid").distinct(), "qid", "left_anti").filter(~F.col("gold").rlike("^-?[0-9]+([.][0-9]+)?$"))
    kept = contexts.join(left.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda c: c["content"]), "\n").alias("contexts"))
    return left.join(kept, "qid", "left").select("qid", "gold", F.coalesce("contexts", F.lit("")).alias("contexts"))
