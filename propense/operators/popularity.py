"""Popularity baseline, alias resolution, id statistics and name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propense.operators.joins import lookup_join


def resolve_aliases(interactions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace item ids that have a canonical id; all others stay."""
    lookup = aliases.select(F.col("bad_id").alias("item_id"), F.col("good_id").alias("_good"))
    joined = lookup_join(interactions, lookup, "item_id")
    return joined.withColumn("item_id", F.coalesce("_good", "item_id")).select(*interactions.columns)


def popularity(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    """`item_id, popularity`: the sum of an item's ratings."""
    return ratings.groupBy("item_id").agg(F.sum(rating).alias("popularity"))


def predict_popularity(pairs: DataFrame, popular: DataFrame) -> DataFrame:
    """Score pairs by item popularity; an unseen item scores 0."""
    scored = lookup_join(pairs, popular, "item_id")
    return scored.withColumn("prediction", F.coalesce("popularity", F.lit(0)).cast("double")).drop("popularity")


def id_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, population deviation, maximum and minimum of id columns, one row per column."""
    stats = []
    for c in columns:
        value = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(value).alias("count"),
                F.avg(value).alias("mean"),
                F.stddev_pop(value).alias("stdev"),
                F.max(value).alias("max"),
                F.min(value).alias("min"),
            )
        )
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def names_of(names: DataFrame, ids: DataFrame) -> DataFrame:
    """Names of the items in `ids`."""
    return names.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def name_of(names: DataFrame, item_id: int) -> DataFrame:
    """Point lookup of one item's names."""
    return names.where(F.col("item_id") == item_id).select("name")
