"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propense.operators.joins import lookup_join
from propense.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """`id` and `component` (the smallest id reachable, itself included) of every id in columns `a` and `b`.

    Links are turned into stars round by round: each id's larger neighbours move
    to its smallest neighbour, then its smaller ones do. A star stays as it is,
    and the number of rounds grows with the logarithm of the longest path. An
    id's neighbours are never gathered: only their minimum is, and an id with
    very many of them is salted when it meets its minimum.
    """
    links = links.select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down"))
    links = stage(links.where("up != down").distinct(), "links")
    while not _stars(links):
        both = links.union(links.select("down", "up")).toDF("id", "other")
        least = stage(both.groupBy("id").agg(F.min("other").alias("least")), "least")
        large = stage(
            lookup_join(both, least, "id", "inner")
            .where("other > id")
            .select(F.col("other").alias("up"), F.least("least", "id").alias("down"))
            .distinct(),
            "links",
        )
        least = stage(large.groupBy("up").agg(F.min("down").alias("least")), "least")
        links = stage(
            lookup_join(large, least, "up", "inner")
            .where("down != least")
            .select(F.col("down").alias("up"), F.col("least").alias("down"))
            .union(least.select("up", F.col("least").alias("down")))
            .distinct(),
            "links",
        )
    named = links.select(F.col("up").alias("id"), F.col("down").alias("component"))
    return stage(named.union(links.select("down", "down").distinct()), "components")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (`id`, `component`) that `components` has given, joined further by new links `a`, `b`.

    Only links between components are followed, so the work of many rounds is
    that of their new links, and none where there are none.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        named = labels.toDF(end, "_named")
        ends = lookup_join(ends, named, end).withColumn(end, F.coalesce("_named", end)).drop("_named")
    ends = stage(ends.where("a != b").distinct(), "links")
    if ends.isEmpty():
        return labels
    moved = components(ends)
    left = lookup_join(labels, moved.toDF("component", "_moved"), "component")
    fresh = moved.join(labels.select("id"), "id", "left_anti")
    return stage(left.select("id", F.coalesce("_moved", "component").alias("component")).union(fresh), "components")


def _stars(links: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and that has none."""
    ends = links.select(F.col("up").alias("id"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).union(
        links.select("down", F.lit(0), F.lit(1))
    )
    counts = ends.groupBy("id").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return counts.where("smaller > 1 OR (smaller = 1 AND larger = 1)").isEmpty()
