"""Per-user negative sampling for ranking evaluation."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propense.functions.hashing import draw
from propense.operators.joins import lookup_join
from propense.operators.quantiles import dense_index
from propense.sources.staging import stage

# Draws per generated group: a user with many draws is spread over many groups.
CHUNK = 4096


def sample_negatives(
    positives: DataFrame, items: DataFrame, seed: int, exclude: DataFrame | None = None
) -> DataFrame:
    """For a user with m distinct positives, the first m of up to n_items uniform draws that miss them.

    Draw number i of a user is a hash of (user, i), with replacement, from the
    dense item list. `exclude` adds further (user, item) pairs to avoid, such as
    training rows. Returns `user_id, draw, item_id`.

    The draws come in rounds: each round generates what the acceptance rate
    says a user still needs, so nothing near users x items is materialised, and
    users that fall short go on where they stopped until they have m negatives
    or have used n_items draws.
    """
    taken = stage(positives.select("user_id", "item_id").distinct(), "positives")
    dictionary = stage(dense_index(items.select("item_id").distinct(), "item_id", "_index"), "items")
    n_items = dictionary.count()
    pending = taken.groupBy("user_id").agg(F.count("*").alias("need"))
    if exclude is None:
        avoid = taken
        pending = pending.withColumn("_avoided", F.col("need"))
    else:
        avoid = stage(taken.union(exclude.select("user_id", "item_id")).distinct(), "avoid")
        pending = pending.join(avoid.groupBy("user_id").agg(F.count("*").alias("_avoided")), "user_id")
    pending = pending.withColumn("next", F.lit(0).cast("bigint"))
    rounds = []
    while True:
        pending = stage(_with_width(pending, n_items), "pending")
        longest = pending.agg(F.max("width")).first()[0]
        if longest is None:
            break
        named = lookup_join(_draw(pending, n_items, seed), dictionary, "_index", "inner")
        valid = named.join(avoid, ["user_id", "item_id"], "left_anti")
        if longest <= CHUNK:
            kept = stage(_first_of_few(valid), "negatives")
        else:
            kept = stage(_first(stage(valid, "valid")), "negatives")
        rounds.append(kept)
        got = kept.groupBy("user_id").agg(F.count("*").alias("_got"))
        pending = (
            pending.join(got, "user_id", "left")
            .select(
                "user_id",
                (F.col("need") - F.coalesce("_got", F.lit(0))).alias("need"),
                "_avoided",
                (F.col("next") + F.col("width")).alias("next"),
            )
            .where((F.col("need") > 0) & (F.col("next") < n_items))
        )
    empty = taken.where(F.lit(False)).select("user_id", F.lit(0).cast("bigint").alias("draw"), "item_id")
    return functools.reduce(DataFrame.unionByName, rounds, empty)


def _with_width(pending: DataFrame, n_items: int) -> DataFrame:
    """How many draws each user makes in this round."""
    free = F.greatest(F.lit(n_items) - F.col("_avoided"), F.lit(0))
    expected = F.ceil(F.col("need") * 1.2 * n_items / F.nullif(free, F.lit(0))) + 16
    left = F.lit(n_items) - F.col("next")
    return pending.withColumn("width", F.least(left, F.coalesce(expected, left)).cast("bigint"))


def _draw(pending: DataFrame, n_items: int, seed: int) -> DataFrame:
    """Rows `user_id, need, draw, chunk, _index`, a user's draws cut into chunks that move to other tasks."""
    last = F.col("next") + F.col("width") - 1
    chunks = pending.select(
        "user_id",
        "need",
        "next",
        last.alias("_last"),
        F.explode(F.sequence(F.floor(F.col("next") / CHUNK), F.floor(last / CHUNK))).alias("chunk"),
    ).repartition("user_id", "chunk")
    first = F.greatest(F.col("next"), F.col("chunk") * CHUNK)
    end = F.least(F.col("_last"), F.col("chunk") * CHUNK + (CHUNK - 1))
    return chunks.select("user_id", "need", "chunk", F.explode(F.sequence(first, end)).alias("draw")).withColumn(
        "_index", (draw(seed, F.col("user_id"), F.col("draw")) % n_items).cast("int")
    )


def _first_of_few(valid: DataFrame) -> DataFrame:
    """Each user's first `need` valid draws, where no user has more than CHUNK draws."""
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("draw"))
    return (
        valid.withColumn("_position", position)
        .where(F.col("_position") <= F.col("need"))
        .select("user_id", "draw", "item_id")
    )


def _first(valid: DataFrame) -> DataFrame:
    """Each user's first `need` valid draws: numbered within chunks, shifted by the chunks before."""
    before = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        valid.groupBy("user_id", "chunk")
        .count()
        .select("user_id", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    position = F.row_number().over(Window.partitionBy("user_id", "chunk").orderBy("draw"))
    return (
        valid.withColumn("_position", position)
        .join(shifts, ["user_id", "chunk"])
        .where(F.col("_position") + F.col("_shift") <= F.col("need"))
        .select("user_id", "draw", "item_id")
    )
