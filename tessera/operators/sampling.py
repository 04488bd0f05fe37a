"""Deterministic samples: rows are ordered by a hash of their key, so partitioning doesn't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, stratum: str, key: str, seed: int | None = 42) -> DataFrame:
    """df with place: 1, 2, ... within each stratum, in an order drawn by the seed, or without one in the order of keys."""
    by = F.xxhash64(F.col(key), F.lit(seed)) if seed is not None else F.col(key)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(by, key)))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int | None = 42) -> DataFrame:
    """n rows of each stratum; without a seed those with the smallest keys."""
    return numbered(df, stratum, key, seed).where(F.col("place") <= n).drop("place")


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by `order`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def with_distractors(targets: DataFrame, wanted: DataFrame, n: int, key: str = "entity_id", seed: int | None = 42) -> DataFrame:
    """All wanted targets and n others, one row per key; without a seed the others with the smallest keys."""
    keep = targets.join(wanted.select(key), key, "left_semi").dropDuplicates([key])
    rest = targets.join(wanted.select(key), key, "left_anti").dropDuplicates([key])
    by = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)] if seed is not None else [F.col(key)]
    return keep.unionByName(rest.orderBy(*by).limit(n))
