"""Mean per-user area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propense.operators.quantiles import range_splits, with_range
from propense.sources.staging import stage


def user_auc(positives: DataFrame, negatives: DataFrame, ties: str = "wrong") -> DataFrame:
    """Share of (positive, negative) pairs ranked correctly, for users that have both.

    Takes `user_id, prediction` on both sides and gives `user_id, correct,
    pairs, auc`. No pair is formed: equal scores are counted per user, and a
    positive's correct pairs are the negatives below it in score order. That
    order runs within score ranges, shifted by the totals of the lower ranges,
    so one user's long list is spread over many tasks. A tied pair counts as
    wrong, or with `ties="half"` as half right. Pairs are counted in doubles,
    since a long list has more of them than a 64-bit integer holds.
    """
    scored = positives.select("user_id", "prediction", F.lit(1).alias("p"), F.lit(0).alias("n")).unionAll(
        negatives.select("user_id", "prediction", F.lit(0).alias("p"), F.lit(1).alias("n"))
    )
    scored = stage(scored.where(F.col("prediction").isNotNull() & ~F.isnan("prediction")), "scored")
    ranged = with_range(scored, "prediction", range_splits(scored, "prediction"))
    counted = ranged.groupBy("user_id", "_range", "prediction").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    below = Window.partitionBy("user_id", "_range").orderBy("prediction").rowsBetween(Window.unboundedPreceding, -1)
    tied = F.col("n") / 2 if ties == "half" else F.lit(0.0)
    inside = (
        counted.withColumn("_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
        .groupBy("user_id", "_range")
        .agg(
            F.sum(F.col("p").cast("double") * (F.col("_below") + tied)).alias("correct"),
            F.sum("p").alias("p"),
            F.sum("n").alias("n"),
        )
    )
    lower = Window.partitionBy("user_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        inside.withColumn("_lower", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        .groupBy("user_id")
        .agg(
            F.sum(F.col("correct") + F.col("p").cast("double") * F.col("_lower")).alias("correct"),
            (F.sum("p").cast("double") * F.sum("n")).alias("pairs"),
        )
        .where(F.col("pairs") > 0)
        .withColumn("auc", F.col("correct") / F.col("pairs"))
    )


def mean_auc(positives: DataFrame, negatives: DataFrame, ties: str = "wrong") -> DataFrame:
    """One row with the mean over users."""
    return user_auc(positives, negatives, ties).agg(F.avg("auc").alias("auc"), F.count("*").alias("users"))
