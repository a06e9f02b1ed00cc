"""Samples by the order of a hash: the same rows whenever they are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), F.col(key)]


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows; fails if there are fewer."""
    found = rows.orderBy(*hash_order(key, seed)).limit(n)
    if found.count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return found


def sample_a_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each group, or all if there are fewer."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*hash_order(key, seed)))
    return rows.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")
