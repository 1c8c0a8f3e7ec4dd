"""Queries around fitted models: ALS, K-means and LDA.

Fitted numbers have no SQL; where a result follows exactly from the input (keys,
counts, totals, means) it does.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propense import jobs
from propense.functions import parsing
from propense.operators import clusters, evaluation, recommend, topics
from propense.operators.features import user_vectors, vector_element
from propense.operators.quintiles import quintile_scores
from propense.operators.recommend import Settings
from propense.operators.splits import split_number, with_stratified_split
from propense.operators.trials import choices, grid, log_spaced
from propense.plans.featuring import PLAYERS_SQL, entries_of
from propense.plans.fixtures import (
    CHANNEL,
    INTERACTIONS_SQL,
    MODELING_SQL,
    RATED_SQL,
    SEED,
    TARGET_ITEM,
    draw_sql,
    interactions,
    modeling,
    rated,
    table,
)
from propense.plans.ingest import EVENT_TYPES, event_counts
from propense.plans.measuring import PARTED_SQL, rounded
from propense.plans.registry import query
from propense.plans.splitting import held_out
from propense.sources.sinks import load_model, save_model
from propense.sources.staging import stage, staging_path

# The settings of a production model.
IMPLICIT = Settings(rank=56, iterations=100, reg=0.1662, alpha=32.6604, seed=SEED)
EXPLICIT = Settings(rank=8, iterations=50, reg=0.01, implicit=False, seed=SEED)
SAMPLE_USER = 7


def _audience_inputs(spark: SparkSession, sf_dir: str):
    """Staged ratings of one channel by login days, and the target's users of all channels."""
    rows = stage(modeling(spark, sf_dir).select("user_id", "item_id", "channel", "active_days"), "modeling")
    one = rows.where(F.col("channel") == CHANNEL)
    ratings = one.select("user_id", "item_id", F.when(F.col("active_days") >= 2, 1.0).otherwise(0.0).alias("rating"))
    return ratings, recommend.players_of(rows, TARGET_ITEM)


@query()
def als_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users likely to take up the target item, with their predictions."""
    ratings, players = _audience_inputs(spark, sf_dir)
    return recommend.audience(recommend.fit(ratings, IMPLICIT), ratings, players, TARGET_ITEM)


@query(f"""WITH {MODELING_SQL}, {PLAYERS_SQL}
SELECT DISTINCT user_id, {TARGET_ITEM} AS item_id FROM modeling
WHERE channel = {CHANNEL} AND user_id NOT IN (SELECT user_id FROM players)""")
def als_audience_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user that is scored for the audience."""
    ratings, players = _audience_inputs(spark, sf_dir)
    model = recommend.fit(ratings, IMPLICIT)
    scored = recommend.predict_item(model, recommend.non_players(ratings, players), TARGET_ITEM)
    return scored.where(F.col("prediction").isNotNull()).select(F.col("user_id").cast("bigint"), "item_id")


@query()
def als_implicit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pairs with fact and prediction."""
    _, train, test = held_out(spark, sf_dir)
    return recommend.predict(recommend.fit(train, IMPLICIT), test)


@query(f"""WITH {PARTED_SQL} SELECT user_id, item_id, rating FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""")
def als_scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pairs of known users and items get a prediction, the others are absent."""
    _, train, test = held_out(spark, sf_dir)
    scored = recommend.predict(recommend.fit(train, IMPLICIT), test)
    return scored.where(F.col("prediction").isNotNull()).select("user_id", "item_id", "rating")


@query()
def als_explicit_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit model of quintile scores: error of the predicted scores on held-out pairs."""
    train, test = _scored_parts(spark, sf_dir)
    return evaluation.mean_squared_error(recommend.predict(recommend.fit(train, EXPLICIT), test))


def _scored_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quintile scores as ratings, nine tenths for training."""
    rows = interactions(spark, sf_dir).select(
        "user_id", "item_id", "active_days", F.coalesce("revenue", F.lit(0)).alias("revenue")
    )
    scored = quintile_scores(stage(rows, "activity"), "active_days", "revenue").withColumnRenamed("score", "rating")
    parts = stage(scored.withColumn("split", split_number([0.9, 0.1], SEED)), "scored", partition_by="split")
    return parts.where("split = 0"), parts.where("split = 1")


@query(f"WITH {RATED_SQL} SELECT DISTINCT user_id, TRUE AS nonnegative, TRUE AS solved FROM rated")
def als_nonnegative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No factor of a non-negative model is below zero, and none could be better."""
    settings = Settings(rank=10, iterations=20, reg=0.01, alpha=0.01, nonnegative=True, seed=SEED)
    rows = stage(rated(spark, sf_dir), "rated")
    model = recommend.fit(rows, settings)
    factors = recommend.user_factors(model).join(_solved(model, rows, 1e-3), "user_id")
    return factors.select("user_id", (F.array_min("user_factor") >= 0).alias("nonnegative"), "solved")


def _solved(model: recommend.Model, ratings: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """`user_id, solved`: whether a user's factor solves the user's equations to single precision."""
    found = recommend.residuals(model, ratings)
    return found.select("user_id", (F.col("residual") <= tolerance * F.col("scale")).alias("solved"))


@query(f"WITH {RATED_SQL} SELECT DISTINCT user_id, {IMPLICIT.rank} AS rank, TRUE AS solved FROM rated")
def als_user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user has one factor row of the model's rank, which solves the user's normal equations."""
    rows = stage(rated(spark, sf_dir), "rated")
    model = recommend.fit(rows, IMPLICIT)
    factors = recommend.user_factors(model).join(_solved(model, rows), "user_id")
    return factors.select("user_id", F.size("user_factor").alias("rank"), "solved")


@query(f"WITH {RATED_SQL} SELECT DISTINCT user_id + {1 << 40} AS user_id, TRUE AS solved FROM rated")
def als_wide_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User ids beyond 32 bits: every user under the own id, with a factor that solves the user's equations."""
    rows = stage(rated(spark, sf_dir).withColumn("user_id", F.col("user_id") + F.lit(1 << 40)), "rated")
    return _solved(recommend.fit(rows, replace(IMPLICIT, rank=10, iterations=20)), rows)


@query(f"""WITH {INTERACTIONS_SQL} SELECT DISTINCT user_id, TRUE AS solved FROM interactions
WHERE {draw_sql(SEED, "user_id", "item_id")} < {round(2147483647 * 0.9)}""")
def als_explicit_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training user's factor of the explicit model solves the user's normal equations."""
    train, _ = _scored_parts(spark, sf_dir)
    return _solved(recommend.fit(train, EXPLICIT), train)


@query(f"WITH {RATED_SQL} SELECT DISTINCT user_id, CAST(5 AS BIGINT) AS items FROM rated")
def als_recommend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user gets five different items."""
    rows = stage(rated(spark, sf_dir), "rated")
    top = recommend.recommend(recommend.fit(rows, IMPLICIT), None, 5)
    return top.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(
        F.count_distinct("item_id").alias("items")
    )


@query(f"WITH {RATED_SQL} SELECT DISTINCT user_id, CAST(5 AS BIGINT) AS items, TRUE AS in_order, TRUE AS best FROM rated")
def als_best_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best items of every user: predictions as the factors give them, in order, and none left out beats the last."""
    rows = stage(rated(spark, sf_dir), "rated")
    model = recommend.fit(rows, replace(IMPLICIT, rank=10, iterations=20))
    top = stage(recommend.recommend(model, None, 5), "best")
    last = top.groupBy("user_id").agg(F.min("prediction").alias("last"))
    beaten = recommend.above(model, last)
    again = recommend.predict(model, top.withColumnRenamed("prediction", "said"))
    before = F.lag("said").over(Window.partitionBy("user_id").orderBy("place"))
    checked = again.withColumn("fine", (F.abs(F.col("said") - F.col("prediction")) < 1e-9) & (F.coalesce(before, F.lit(1e300)) >= F.col("said")))
    found = checked.groupBy("user_id").agg(F.count_distinct("item_id").alias("items"), F.bool_and("fine").alias("in_order"))
    return found.join(beaten, "user_id").select("user_id", "items", "in_order", (F.col("items_above") < 5).alias("best"))


@query()
def als_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per user with the recommended items in order."""
    rows = stage(rated(spark, sf_dir), "rated")
    return recommend.recommendation_lines(recommend.fit(rows, IMPLICIT), rows, 5)


@query()
def als_recommended_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a user's items and of the items recommended to the user."""
    rows = stage(rated(spark, sf_dir), "rated")
    model = recommend.fit(rows, IMPLICIT)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"))
    user = rows.where(F.col("user_id") == SAMPLE_USER)
    return recommend.existing_and_recommended(rows, recommend.recommend(model, user, 5), names, SAMPLE_USER)


@query()
def als_population_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics on held-out rows of the target item and of the others, from one model."""
    strata = with_stratified_split(rated(spark, sf_dir), TARGET_ITEM, [0.9, 0.1], [0.99, 0.01], SEED)
    parts = stage(strata, "strata", partition_by="split")
    return rounded(
        jobs.evaluate_model(parts.where("split = 0"), parts.where("split = 1"), IMPLICIT, ["population"])
    )


@query()
def als_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four folds over the target item's rows, all other rows in every training set; mean and spread of recall."""
    rows = stage(rated(spark, sf_dir), "rated")
    is_target = F.col("item_id") == TARGET_ITEM
    return jobs.cross_validate(rows.where(~is_target), rows.where(is_target), IMPLICIT, SEED)


@query()
def als_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified hold-out metrics of randomly chosen parameters."""
    strata = with_stratified_split(rated(spark, sf_dir), TARGET_ITEM, [0.9, 0.1], [0.99, 0.01], SEED)
    parts = stage(strata, "strata", partition_by="split")
    points = grid(spark, choices("rank", *range(2, 100, 2)), log_spaced("reg", 0.01, 50, 100), log_spaced("alpha", 0.01, 50, 100))
    return jobs.search_parameters(parts, points, 3, Settings(iterations=100, seed=SEED), ["population"])


@query()
def als_auc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per-user AUC of a small grid and of the popularity baseline, best first."""
    rows, train, held = held_out(spark, sf_dir)
    points = grid(spark, choices("rank", 10, 50), choices("reg", 1.0, 0.0001), choices("alpha", 1.0, 40.0))
    return jobs.compare_auc(train, held, rows, points, 8, Settings(iterations=10, seed=SEED))


@query()
def als_published_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audience as stored; the model is stored beside it."""
    ratings, players = _audience_inputs(spark, sf_dir)
    path, model_path = staging_path(spark, "audience"), staging_path(spark, "als")
    jobs.publish_audience(ratings, players, TARGET_ITEM, IMPLICIT, "audience", path, model_path)
    return spark.read.parquet(path)


# --- K-means over user vectors of active days


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the target item's users marked and a tenth of them held out."""
    entries, dictionary = entries_of(spark, sf_dir, "active_days")
    index = dictionary.where(F.col("item_id") == TARGET_ITEM).first()["item_index"]
    vectors = user_vectors(entries, dictionary.count())
    marked = vectors.withColumn("is_target", vector_element(F.col("features"), index) >= 1)
    held = F.col("is_target") & (split_number([0.9, 0.1], SEED, ("user_id",)) == 1)
    return stage(marked.withColumn("held_out", held), "clustered")


@query(f"WITH {INTERACTIONS_SQL} SELECT DISTINCT user_id, TRUE AS nearest FROM interactions")
def kmeans_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is assigned to a nearest centre."""
    vectors = _clustered(spark, sf_dir).select("user_id", "features")
    model = clusters.fit(vectors, 10, SEED)
    measured = clusters.distances(model.transform(vectors), model)
    mine = F.get("distances", F.col("cluster"))
    return measured.select("user_id", (mine <= F.array_min("distances") + 1e-9).alias("nearest"))


@query()
def kmeans_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centres(clusters.fit(_clustered(spark, sf_dir), 10, SEED), spark)


@query()
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all users, stored."""
    vectors = _clustered(spark, sf_dir)
    model = clusters.fit(vectors, 10, SEED)
    return stage(clusters.assign(model, vectors.select("user_id", "features")), "clusters")


_SEGMENTS_SQL = f"""users AS (
  SELECT user_id, bool_or(item_id = {TARGET_ITEM}) AS is_target FROM interactions GROUP BY 1)"""


@query(f"""WITH {INTERACTIONS_SQL}, {_SEGMENTS_SQL}
SELECT 'all' AS segment, count(*) AS users FROM users
UNION ALL SELECT 'target', count(*) FILTER (WHERE is_target) FROM users
UNION ALL SELECT 'test', count(*) FILTER (WHERE is_target AND {draw_sql(SEED, "user_id")} >= {round(2147483647 * 0.9)}) FROM users""")
def kmeans_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster sizes of each segment add up to the segment."""
    vectors = _clustered(spark, sf_dir)
    report = clusters.report(clusters.assign(clusters.fit(vectors, 10, SEED), vectors))
    return report.groupBy("segment").agg(F.sum("count").alias("users"))


@query()
def kmeans_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sizes of all, target and held-out users under the best number of clusters."""
    _, _, assigned = jobs.best_clustering(_clustered(spark, sf_dir), clusters.CLUSTER_NUMBERS, SEED, parallelism=2)
    return clusters.report(assigned)


@query()
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out recall and cost for several numbers of clusters."""
    return clusters.sweep(_clustered(spark, sf_dir), clusters.CLUSTER_NUMBERS, SEED, parallelism=3)


@query()
def kmeans_lowest_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = clusters.sweep(_clustered(spark, sf_dir), tuple(range(2, 201)), SEED, parallelism=3)
    return clusters.lowest_cost(trials)


@query(f"""SELECT k.position, CAST(count(*) FILTER (WHERE e.event_type = k.kind) AS DOUBLE) AS total
FROM events e CROSS JOIN (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(EVENT_TYPES))}) k(position, kind) GROUP BY 1""")
def lda_term_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term's weights add up over the topics to its number of occurrences."""
    weights = topics.topic_terms(_topics(spark, sf_dir), spark)
    return weights.groupBy(F.col("term").alias("position")).agg(F.round(F.sum("weight"), 3).alias("total"))


def _topics(spark: SparkSession, sf_dir: str):
    counts = parsing.parse_counts(event_counts(spark, sf_dir))
    return topics.fit(stage(topics.count_vectors(counts), "corpus"), 3, 20, SEED)


@query()
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_terms(_topics(spark, sf_dir), spark)


@query(f"""WITH {RATED_SQL} SELECT DISTINCT user_id, TRUE AS same_factors, TRUE AS same_cluster FROM rated""")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored models give the same factors and clusters when loaded again."""
    rows = stage(rated(spark, sf_dir), "rated")
    als = recommend.fit(rows, IMPLICIT)
    entries, dictionary = entries_of(spark, sf_dir, "active_days")
    vectors = user_vectors(entries, dictionary.count())
    kmeans = clusters.fit(vectors, 5, SEED)
    paths = {kind: staging_path(spark, kind) for kind in ("als", "kmeans")}
    save_model(als, paths["als"])
    save_model(kmeans, paths["kmeans"])

    stored = recommend.user_factors(load_model("als", paths["als"])).withColumnRenamed("user_factor", "stored_factor")
    factors = recommend.user_factors(als).join(stored, "user_id").select(
        F.col("user_id").cast("bigint").alias("user_id"),
        (F.col("user_factor") == F.col("stored_factor")).alias("same_factors"),
    )
    again = clusters.assign(load_model("kmeans", paths["kmeans"]), vectors).withColumnRenamed("cluster", "stored")
    assigned = clusters.assign(kmeans, vectors).join(again, "user_id")
    return factors.join(
        assigned.select("user_id", (F.col("cluster") == F.col("stored")).alias("same_cluster")), "user_id"
    )


@query(f"""SELECT user_id, position,
CAST(count(*) FILTER (WHERE event_type = kind) AS DOUBLE) AS value FROM events CROSS JOIN (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(EVENT_TYPES))}) k(position, kind) GROUP BY 1, 2""")
def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors stored with their ids and read back."""
    rows = topics.count_vectors(parsing.parse_counts(event_counts(spark, sf_dir)))
    stored = stage(rows, "vectors")
    return stored.select("user_id", F.posexplode(vector_to_array("features")).alias("position", "value"))
