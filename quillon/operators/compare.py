"""Pairing of runs and of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import prefix

KEY = ["sample_id", "variant", "transform", "attack_position"]


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the last by order."""
    return (
        df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("kept")).select(*key, "kept.*")
    )


def pair_runs(a: DataFrame, b: DataFrame, value: str = "is_unsafe", variants: list[str] | None = None) -> DataFrame:
    """Inner join of two runs on their natural key; null positions match each other."""
    if variants:
        a, b = a.where(F.col("variant").isin(variants)), b.where(F.col("variant").isin(variants))
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in KEY], F.col(value).alias("b"))
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in KEY]
    return a.select(*KEY, F.col(value).alias("a")).join(right, same).select(*KEY, "a", "b")


def pair_variants(records: DataFrame, first: str = "attacked", second: str = "defended_attack", value: str = "is_unsafe") -> DataFrame:
    """Two variants of one run side by side, in one pass."""
    key = ["sample_id", "transform", "attack_position"]
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col(value)))
    wide = records.where(F.col("variant").isin(first, second)).groupBy(*key).agg(
        pick(first).alias("a"), pick(second).alias("b"), F.countDistinct("variant").alias("n")
    )
    return wide.where("n = 2").drop("n")


def with_missing(names: DataFrame, found: DataFrame, on: str = "run") -> DataFrame:
    """Every name, with nulls where nothing was found."""
    return names.join(found, on, "left")


def unknown(names: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return names.join(known, on, "left_anti")


def first_per(df: DataFrame, by: str, order: str) -> DataFrame:
    """First row of each group."""
    return df.groupBy(by).agg(F.min_by(F.struct(*[c for c in df.columns if c != by]), order).alias("r")).select(by, "r.*")


def running_best(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The rows with the least value so far, in order within by; one series of any length is spread over tasks."""
    return prefix.running(df, [order], value, "best", "min", by)
