"""Dictionary, vectors, popularity, names and membership."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.functions import parsing
from propense.operators import popularity as pop
from propense.operators.features import indexed_entries, item_dictionary, reindex, user_vectors, users_above, vector_cells
from propense.operators.lookalike import flag_members
from propense.operators.recommend import non_players, players_of
from propense.plans.fixtures import (
    CHANNEL,
    INTERACTIONS_SQL,
    MODELING_SQL,
    RATED_SQL,
    TARGET_ITEM,
    interactions,
    modeling,
    rated,
    table,
)
from propense.plans.ingest import _ALIASES_SQL, alias_lines, name_lines
from propense.plans.registry import query
from propense.plans.splitting import held_out, split_sql
from propense.sources.staging import stage

DICTIONARY_SQL = """dictionary AS (
  SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_index
  FROM (SELECT DISTINCT item_id FROM interactions))"""


@query(f"WITH {INTERACTIONS_SQL}, {DICTIONARY_SQL} SELECT item_id, item_index FROM dictionary")
def item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_dictionary(interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS_SQL}
SELECT CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_id, item_id, strength FROM interactions""")
def reindexed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User ids replaced by dense ones, as models with 32-bit ids need."""
    rows = stage(interactions(spark, sf_dir).select("user_id", "item_id", "strength"), "interactions")
    return reindex(rows, "user_id")[0]


def entries_of(spark: SparkSession, sf_dir: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Matrix entries and the item dictionary."""
    rows = stage(interactions(spark, sf_dir).select("user_id", "item_id", value), "interactions")
    dictionary = stage(item_dictionary(rows), "dictionary")
    return indexed_entries(rows, dictionary, value), dictionary


def _vectors_sql(value: str) -> str:
    return f"""WITH {INTERACTIONS_SQL}, {DICTIONARY_SQL}
SELECT i.user_id, d.item_index, CAST(coalesce(i.{value}, 0) AS DOUBLE) AS value
FROM interactions i JOIN dictionary d ON i.item_id = d.item_id WHERE coalesce(i.{value}, 0) <> 0"""


def _vectors_long(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    entries, dictionary = entries_of(spark, sf_dir, value)
    vectors = user_vectors(entries, dictionary.count())
    return vector_cells(vectors, "features").where(F.col("value") != 0)


@query(_vectors_sql("active_days"))
def user_vectors_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User vectors of active days, shown element by element without the zeros."""
    return _vectors_long(spark, sf_dir, "active_days")


@query(_vectors_sql("revenue"))
def user_vectors_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors_long(spark, sf_dir, "revenue")


@query(f"""WITH {INTERACTIONS_SQL} SELECT user_id FROM interactions WHERE item_id = {TARGET_ITEM} AND active_days > 1""")
def vector_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose element for the target item exceeds 1."""
    entries, dictionary = entries_of(spark, sf_dir, "active_days")
    index = dictionary.where(F.col("item_id") == TARGET_ITEM).first()["item_index"]
    return users_above(entries, index, 1)


@query(f"""WITH {INTERACTIONS_SQL}, {_ALIASES_SQL}
SELECT user_id, coalesce(good_id, item_id) AS item_id, sum(strength) AS strength
FROM interactions LEFT JOIN aliases ON item_id = bad_id GROUP BY 1, 2""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions under their canonical items; merged pairs are added up."""
    rows = interactions(spark, sf_dir).select("user_id", "item_id", "strength")
    resolved = pop.resolve_aliases(rows, parsing.parse_aliases(alias_lines(spark, sf_dir)))
    return resolved.groupBy("user_id", "item_id").agg(F.sum("strength").alias("strength"))


@query(f"""WITH {INTERACTIONS_SQL}
SELECT 'user_id' AS "column", count(*) AS count, round(avg(user_id), 6) AS mean, round(stddev_pop(user_id), 6) AS stdev,
       CAST(max(user_id) AS DOUBLE) AS max, CAST(min(user_id) AS DOUBLE) AS min FROM interactions
UNION ALL
SELECT 'item_id', count(*), round(avg(item_id), 6), round(stddev_pop(item_id), 6),
       CAST(max(item_id) AS DOUBLE), CAST(min(item_id) AS DOUBLE) FROM interactions""")
def id_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pop.id_stats(interactions(spark, sf_dir), ["user_id", "item_id"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "stdev")})


@query(f"""WITH {INTERACTIONS_SQL} SELECT item_id, sum(strength) AS popularity FROM interactions GROUP BY 1""")
def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pop.popularity(interactions(spark, sf_dir), "strength")


@query(f"""WITH {RATED_SQL}, parted AS (SELECT *, {split_sql([0.9])} AS split FROM rated),
popular AS (SELECT item_id, sum(rating) AS popularity FROM parted WHERE split = 0 GROUP BY 1)
SELECT p.user_id, p.item_id, p.rating, coalesce(popularity, 0) AS prediction
FROM parted p LEFT JOIN popular q ON p.item_id = q.item_id WHERE split = 1""")
def popularity_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pairs scored by the popularity of their item in the training rows."""
    _, train, held = held_out(spark, sf_dir)
    return pop.predict_popularity(held, stage(pop.popularity(train), "popular"))


@query(f"""WITH {INTERACTIONS_SQL}
SELECT DISTINCT CAST(s_suppkey AS INTEGER) AS item_id, s_name AS name FROM supplier JOIN interactions ON s_suppkey = item_id
WHERE active_days > 1 AND s_acctbal >= 0 AND s_nationkey <> 7""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the items somebody used on more than one day."""
    used = interactions(spark, sf_dir).where(F.col("active_days") > 1)
    return pop.names_of(parsing.parse_names(name_lines(spark, sf_dir)), used)


@query(f"SELECT s_name AS name FROM supplier WHERE s_suppkey = {TARGET_ITEM}")
def name_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"))
    return pop.name_of(names, TARGET_ITEM)


PLAYERS_SQL = f"players AS (SELECT DISTINCT user_id FROM modeling WHERE item_id = {TARGET_ITEM})"


@query(f"WITH {MODELING_SQL}, {PLAYERS_SQL} SELECT user_id FROM players")
def players_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the target item, through any channel."""
    return players_of(modeling(spark, sf_dir), TARGET_ITEM)


@query(f"""WITH {MODELING_SQL}, {PLAYERS_SQL}
SELECT DISTINCT user_id FROM modeling WHERE channel = {CHANNEL} AND user_id NOT IN (SELECT user_id FROM players)""")
def non_players_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel's users that do not use the target item through any channel."""
    rows = modeling(spark, sf_dir)
    return non_players(rows.where(F.col("channel") == CHANNEL), players_of(rows, TARGET_ITEM))


@query(f"""WITH {MODELING_SQL}, {PLAYERS_SQL}
SELECT user_id, user_id IN (SELECT user_id FROM players) AS is_target
FROM (SELECT DISTINCT user_id FROM modeling WHERE channel = {CHANNEL})""")
def target_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modeling(spark, sf_dir)
    users = rows.where(F.col("channel") == CHANNEL).select("user_id").distinct()
    return flag_members(users, players_of(rows, TARGET_ITEM))


@query(f"""WITH {RATED_SQL} SELECT rating, count(*) AS count FROM rated GROUP BY 1""")
def count_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).groupBy("rating").count()


@query(f"""WITH {RATED_SQL} SELECT item_id, avg(rating) AS share, CAST(sum(rating) AS BIGINT) AS payers FROM rated GROUP BY 1""")
def payer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and share of a flag."""
    return (
        rated(spark, sf_dir)
        .groupBy("item_id")
        .agg(F.avg("rating").alias("share"), F.sum("rating").cast("bigint").alias("payers"))
    )
