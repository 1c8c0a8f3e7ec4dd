"""Split, fold and sampling queries; the SQL repeats the integer draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.functions.hashing import PRIME, draw
from propense.operators.negatives import sample_negatives
from propense.operators.splits import (
    bernoulli_sample,
    fold_parts,
    with_fold,
    with_split,
    with_stratified_split,
)
from propense.plans.fixtures import (
    INTERACTIONS_SQL,
    RATED_SQL,
    SEED,
    TARGET_ITEM,
    draw_sql,
    interactions,
    rated,
)
from propense.plans.registry import query
from propense.sources.staging import stage

PAIR_DRAW = draw_sql(SEED, "user_id", "item_id")


def split_sql(edges: list[float]) -> str:
    """Number of the part whose range holds the draw; `edges` are the inner cumulative weights."""
    whens = " ".join(f"WHEN {PAIR_DRAW} < {round(PRIME * e)} THEN {i}" for i, e in enumerate(edges))
    return f"CASE {whens} ELSE {len(edges)} END"


@query(f"WITH {RATED_SQL} SELECT user_id, item_id, rating, {split_sql([0.9])} AS split FROM rated")
def split_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(rated(spark, sf_dir), [0.9, 0.1], SEED)


@query(f"WITH {RATED_SQL} SELECT user_id, item_id, rating, {split_sql([0.8, 0.9])} AS split FROM rated")
def split_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(rated(spark, sf_dir), [0.8, 0.1, 0.1], SEED)


@query(f"""WITH {RATED_SQL}
SELECT user_id, item_id, rating, CASE WHEN item_id = {TARGET_ITEM} THEN 'target' ELSE 'other' END AS population,
       CASE WHEN item_id = {TARGET_ITEM} THEN {split_sql([0.9])} ELSE {split_sql([0.99])} END AS split FROM rated""")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stratified_split(rated(spark, sf_dir), TARGET_ITEM, [0.9, 0.1], [0.99, 0.01], SEED)


@query(f"""WITH {RATED_SQL}
SELECT split, population, count(*) AS count FROM (
  SELECT CASE WHEN item_id = {TARGET_ITEM} THEN 'target' ELSE 'other' END AS population,
         CASE WHEN item_id = {TARGET_ITEM} THEN {split_sql([0.5])} ELSE 0 END AS split FROM rated) GROUP BY 1, 2""")
def split_target_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold out rows of the target item only."""
    parts = with_stratified_split(rated(spark, sf_dir), TARGET_ITEM, [0.5, 0.5], [1.0, 0.0], SEED)
    return parts.groupBy("split", "population").count()


@query(f"WITH {RATED_SQL} SELECT user_id, item_id, rating, {split_sql([0.25, 0.5, 0.75])} AS fold FROM rated")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fold(rated(spark, sf_dir), 4, SEED)


@query(f"""WITH {RATED_SQL},
folded AS (SELECT {split_sql([0.25, 0.5, 0.75])} AS fold FROM rated WHERE item_id = {TARGET_ITEM})
SELECT f.fold, (SELECT count(*) FROM rated WHERE item_id <> {TARGET_ITEM})
       + count(*) FILTER (WHERE folded.fold <> f.fold) AS train, count(*) FILTER (WHERE folded.fold = f.fold) AS test
FROM (VALUES (0), (1), (2), (3)) f(fold) CROSS JOIN folded GROUP BY 1""")
def kfold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four folds over the target item's rows, all other rows in every training set."""
    rows = stage(rated(spark, sf_dir), "rated")
    base = rows.where(F.col("item_id") != TARGET_ITEM)
    folded = with_fold(rows.where(F.col("item_id") == TARGET_ITEM), 4, SEED)
    sizes = None
    for fold in range(4):
        train, test = fold_parts(base, folded, fold)
        both = train.select(F.lit(1).alias("train"), F.lit(0).alias("test")).unionAll(
            test.select(F.lit(0).alias("train"), F.lit(1).alias("test"))
        )
        size = both.agg(F.sum("train").alias("train"), F.sum("test").alias("test")).withColumn("fold", F.lit(fold))
        sizes = size if sizes is None else sizes.unionByName(size)
    return sizes


@query(f"""WITH {RATED_SQL} SELECT user_id, item_id, rating FROM rated WHERE {PAIR_DRAW} < {round(PRIME * 0.3)}""")
def bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bernoulli_sample(rated(spark, sf_dir), 0.3, SEED)


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, item_id, {PAIR_DRAW} AS draw FROM interactions")
def uniform_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select(
        "user_id", "item_id", draw(SEED, F.col("user_id"), F.col("item_id")).alias("draw")
    )


# All n_items draws of every user, in order; the first m that miss the user's positives are kept.
NEGATIVES_SQL = f"""held AS (SELECT user_id, item_id, rating FROM rated WHERE {split_sql([0.9])} = 1),
items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM rated)),
wanted AS (SELECT user_id, count(*) AS m FROM held GROUP BY 1),
draws AS (SELECT user_id, m, draw, {draw_sql(SEED, "user_id", "draw")} % (SELECT count(*) FROM items) AS idx
  FROM wanted CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM items))) AS draw)),
valid AS (SELECT d.user_id, d.m, d.draw, i.item_id FROM draws d JOIN items i ON d.idx = i.idx
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = d.user_id AND h.item_id = i.item_id)),
negatives AS (SELECT user_id, draw, item_id FROM valid
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY draw) <= m)"""


def held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rated rows, nine tenths for training and one tenth held out."""
    rows = stage(with_split(rated(spark, sf_dir), [0.9, 0.1], SEED), "rated", partition_by="split")
    parts = [rows.where(F.col("split") == part).drop("split") for part in (0, 1)]
    return rows.drop("split"), *parts


@query(f"WITH {RATED_SQL}, {NEGATIVES_SQL} SELECT user_id, draw, item_id FROM negatives")
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, held = held_out(spark, sf_dir)
    return sample_negatives(held, rows, SEED)
