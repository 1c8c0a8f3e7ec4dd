"""Reproducible splits: every row's place follows from its key and a seed."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propense.functions.hashing import PRIME, draw

KEYS = ("user_id", "item_id")


def split_number(weights: list[float], seed: int, keys: tuple[str, ...] = KEYS) -> Column:
    """Which of the weighted parts a row falls in, from 0 up."""
    total = sum(weights)
    value = draw(seed, *[F.col(k) for k in keys])
    result = F.lit(len(weights) - 1)
    bounds = [round(PRIME * edge / total) for edge in accumulate(weights)][:-1]
    for part, bound in reversed(list(enumerate(bounds))):
        result = F.when(value < bound, F.lit(part)).otherwise(result)
    return result


def random_split(df: DataFrame, weights: list[float], seed: int, keys: tuple[str, ...] = KEYS) -> list[DataFrame]:
    """Weighted split into as many tables as there are weights; no row is drawn twice or lost."""
    numbered = with_split(df, weights, seed, keys)
    return [numbered.where(F.col("split") == part).drop("split") for part in range(len(weights))]


def with_split(df: DataFrame, weights: list[float], seed: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return df.withColumn("split", split_number(weights, seed, keys))


def with_stratified_split(
    df: DataFrame,
    target: int,
    target_weights: list[float],
    other_weights: list[float],
    seed: int,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Split the target item's rows by one set of weights and all others by another, in one pass.

    `population` tells the two strata apart. `other_weights=[1.0, 0.0]` holds
    out rows of the target item only.
    """
    is_target = F.col("item_id") == target
    return df.withColumn("population", F.when(is_target, F.lit("target")).otherwise(F.lit("other"))).withColumn(
        "split",
        F.when(is_target, split_number(target_weights, seed, keys)).otherwise(split_number(other_weights, seed, keys)),
    )


def with_fold(df: DataFrame, folds: int, seed: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return df.withColumn("fold", split_number([1.0] * folds, seed, keys))


def fold_parts(base: DataFrame, folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training rows (the whole base set and all other folds) and the test rows of one fold."""
    others = folded.where(F.col("fold") != fold).drop("fold")
    return base.unionByName(others), folded.where(F.col("fold") == fold).drop("fold")


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keep each row with the given probability, without replacement."""
    return df.where(draw(seed, *[F.col(k) for k in keys]) < round(PRIME * fraction))
