"""Seeded splits and samples by hash order: the same rows on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.batching import numbered
from corvane.session import BROADCAST_ROWS, bounded


def seeded_order(key: str, seed: int) -> list[Column]:
    """A random order of rows: MD5 of key and seed, then the key."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement; fewer where there are fewer.

    A top-n over each task's own top n while n rows fit one task, else the first n of all rows numbered in ranges.
    """
    if n <= BROADCAST_ROWS:
        return rows.orderBy(*seeded_order(key, seed)).limit(n)
    return numbered(rows.withColumn("_mix", seeded_order(key, seed)[0]), ["_mix", key], "_n").where(F.col("_n") < n).drop("_mix", "_n")


def stratified_sample(rows: DataFrame, stratum: str, key: str, k: int, seed: int) -> DataFrame:
    """min(k, size) rows of each stratum."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*seeded_order(key, seed)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def singletons(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows that are alone in their group; counts combine before the shuffle, and hot groups join as one row."""
    alone = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return rows.join(alone, group, "left_semi")


def assign_splits(rows: DataFrame, candidates: DataFrame, key: str, n_test: int, n_val: int, seed: int, check: bool = True) -> DataFrame:
    """rows with split test, val or train.

    Test rows are drawn from the candidates, val rows from all the rest (candidates or not), without replacement.
    Sizes that can't be met are errors.
    """
    if n_test < 0 or n_val < 0:
        raise ValueError("split sizes must not be negative")
    if check:
        total = rows.count()
        if n_test + n_val > total:
            raise ValueError(f"split sizes {n_test} and {n_val} exceed the {total} rows")
        eligible = candidates.count()
        if n_test > eligible:
            raise ValueError(f"only {eligible} rows are eligible for a test split of {n_test}")
    test = seeded_sample(candidates.select(key), key, n_test, seed)
    rest = rows.select(key).join(bounded(test, n_test), key, "left_anti")
    val = seeded_sample(rest, key, n_val, seed + 1)
    named = test.withColumn("split", F.lit("test")).unionByName(val.withColumn("split", F.lit("val")))
    out = rows.join(bounded(named, n_test + n_val), key, "left")
    return out.withColumn("split", F.coalesce("split", F.lit("train")))


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """(split, n, first_key, last_key)."""
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def indexed(rows: DataFrame, indices: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by a list of keys (order, key): its order and repeats stay."""
    return indices.join(rows, key).orderBy(order)


def complement(rows: DataFrame, indices: DataFrame, key: str) -> DataFrame:
    return rows.join(indices, key, "left_anti")


def replicate(rows: DataFrame, n: int) -> DataFrame:
    """Each row n times, numbered by copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
