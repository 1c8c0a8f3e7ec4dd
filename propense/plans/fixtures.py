"""Interaction tables derived from the provided tables, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.functions.hashing import FIRST, PRIME, SECOND

# Parameters of the registered queries.
TARGET_ITEM = 3
CHANNEL = 2
SEED = 20161


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str):
    return F.round(F.col(amount) * 100).cast("bigint")


def _summed(lines: DataFrame, orders: DataFrame, *more_keys: str) -> DataFrame:
    """One row per user, item and further line columns.

    `revenue` (in cents) is null where nothing was bought for keeps,
    `active_days` counts distinct days and `strength` adds up quantities.
    """
    bought = F.when(F.col("l_returnflag") == "A", cents("l_extendedprice"))
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("item_id"), *more_keys)
        .agg(
            F.sum(bought).alias("revenue"),
            F.count_distinct(F.to_date("o_orderdate")).alias("active_days"),
            F.sum("l_quantity").alias("strength"),
        )
    )


def modeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, item and channel."""
    rows = _summed(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_linestatus")
    channel = F.when(F.col("l_linestatus") == "F", CHANNEL).otherwise(1)
    return rows.select("user_id", "item_id", channel.alias("channel"), "revenue", "active_days", "strength")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and item, over all channels."""
    return _summed(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


_SUMS_SQL = """CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END) AS BIGINT) AS revenue,
         count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days,
         sum(l_quantity) AS strength"""

MODELING_SQL = f"""modeling AS (
  SELECT o_custkey AS user_id, l_suppkey AS item_id,
         CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS channel,
         {_SUMS_SQL}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3)"""

INTERACTIONS_SQL = f"""{MODELING_SQL},
interactions AS (
  SELECT o_custkey AS user_id, l_suppkey AS item_id,
         {_SUMS_SQL}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2)"""


def draw_sql(seed: int, first: str, second: str | None = None) -> str:
    """The SQL form of `functions.hashing.draw` for keys that are not negative."""
    total = f"(({first}) % {PRIME}) * {FIRST} + {seed}"
    if second is not None:
        total += f" + (({second}) % {PRIME}) * {SECOND}"
    once = f"(({total}) % {PRIME})"
    twice = f"(({once} * {once} + {once} + {FIRST}) % {PRIME})"
    return f"(({twice} * {twice} + {once} * {SECOND} + {SECOND}) % {PRIME})"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`user_id, item_id, rating`: 1 for pairs with revenue, else 0."""
    from propense.functions.labels import paid

    return interactions(spark, sf_dir).select("user_id", "item_id", paid(F.col("revenue")).alias("rating"))


RATED_SQL = f"""{INTERACTIONS_SQL},
rated AS (
  SELECT user_id, item_id, CASE WHEN coalesce(revenue, 0) > 0 THEN 1.0e0 ELSE 0.0e0 END AS rating FROM interactions)"""
