"""Look-alike ranking queries on a deterministic score and on singular vectors."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense import jobs
from propense.operators import decompose as svd
from propense.operators import lookalike
from propense.operators.recommend import players_of
from propense.plans.featuring import PLAYERS_SQL, entries_of
from propense.plans.fixtures import CHANNEL, INTERACTIONS_SQL, MODELING_SQL, TARGET_ITEM, interactions, modeling
from propense.plans.registry import query
from propense.sources.sinks import publish
from propense.sources.staging import stage, staging_path

_PLACED_SQL = """placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, user_id) AS place, count(*) OVER () AS n FROM scores)"""
_SCORES_SQL = f"""{INTERACTIONS_SQL},
scores AS (SELECT user_id, sum(strength) AS score, bool_or(item_id = {TARGET_ITEM}) AS is_target
  FROM interactions GROUP BY 1),
{_PLACED_SQL}"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the total of their strengths, with a flag for users of the target item."""
    rows = interactions(spark, sf_dir).groupBy("user_id").agg(
        F.sum("strength").alias("score"), F.bool_or(F.col("item_id") == TARGET_ITEM).alias("is_target")
    )
    return stage(rows, "scores")


def _share_sql(percent: str) -> str:
    return f"WITH {_SCORES_SQL} SELECT user_id, score, is_target FROM placed WHERE place <= floor(n * {percent} / 100)"


@query(_share_sql("1.74"))
def top_share_of_a_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share that is no whole percent."""
    return lookalike.top_share(_scores(spark, sf_dir), Decimal("1.74"))


@query(f"WITH {_SCORES_SQL} SELECT user_id, score, is_target FROM scores JOIN (SELECT score AS cut FROM placed "
       "WHERE place = floor(n * 1.1 / 100)) ON score >= cut")
def reached_share_of_a_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone who reaches the last score of the top 1.1 percent."""
    scores = _scores(spark, sf_dir)
    size = lookalike.share_size(scores.count(), Decimal("1.1"))
    return lookalike.at_least(scores, lookalike.top_threshold(scores, size))


@query(_share_sql("10"))
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the top tenth of the users."""
    return lookalike.top_share(_scores(spark, sf_dir), 10)


@query(f"""WITH {_SCORES_SQL},
thresholds AS (SELECT p AS percent, n * p // 100 AS size, score AS threshold
  FROM placed JOIN (SELECT unnest(range(1, 21)) AS p) ON place = n * p // 100)
SELECT CAST(percent AS INTEGER) AS percent, size, threshold, threshold > 0 AS positive, count(*) AS predicted,
       count(*) FILTER (WHERE is_target) AS hits,
       round(count(*) FILTER (WHERE is_target) / (SELECT count(*) FROM scores WHERE is_target), 6) AS recall
FROM thresholds JOIN scores ON score >= threshold GROUP BY 1, 2, 3, 4""")
def lookalike_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the target item's users for the top 1 to 20 percent."""
    return lookalike.sweep(_scores(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_SCORES_SQL} SELECT user_id, score, is_target FROM scores
WHERE score >= (SELECT score FROM placed WHERE place = n * 5 // 100)""")
def above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone at or above the score of the last user of the top 5 percent."""
    scores = _scores(spark, sf_dir)
    return lookalike.at_least(scores, lookalike.top_threshold(scores, scores.count() * 5 // 100))


@query(f"""WITH {_SCORES_SQL} SELECT round(count(*) FILTER (WHERE score >= (SELECT score FROM placed WHERE place = n * 5 // 100))
/ count(*), 6) AS recall FROM scores WHERE is_target""")
def lookalike_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    predicted = lookalike.at_least(scores, lookalike.top_threshold(scores, scores.count() * 5 // 100))
    return lookalike.recall(predicted, scores.where("is_target")).select(F.round("recall", 6).alias("recall"))


_POTENTIAL_SQL = f"""WITH {MODELING_SQL},
scores AS (SELECT user_id, sum(strength) AS score FROM modeling WHERE channel = {CHANNEL} GROUP BY 1),
{_PLACED_SQL}, {PLAYERS_SQL}
SELECT user_id, {TARGET_ITEM} AS item_id, 1.0e0 AS prediction FROM scores
WHERE score >= (SELECT score FROM placed WHERE place = n * 20 // 100) AND user_id NOT IN (SELECT user_id FROM players)"""


def _potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(modeling(spark, sf_dir).select("user_id", "item_id", "channel", "strength"), "modeling")
    scores = rows.where(F.col("channel") == CHANNEL).groupBy("user_id").agg(F.sum("strength").alias("score"))
    scores = stage(scores, "scores")
    predicted = lookalike.at_least(scores, lookalike.top_threshold(scores, scores.count() * 20 // 100))
    return lookalike.potential_users(predicted, players_of(rows, TARGET_ITEM), TARGET_ITEM)


@query(_POTENTIAL_SQL)
def potential_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 20 percent without the target item's users of any channel."""
    return _potential(spark, sf_dir)


@query(_POTENTIAL_SQL)
def publish_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list through a view and a stored table."""
    path = staging_path(spark, "audience")
    publish(_potential(spark, sf_dir), "potential_audience", path)
    return spark.read.parquet(path)


# --- singular value decomposition


def _decomposed(spark: SparkSession, sf_dir: str, k: int | None) -> svd.Decomposition:
    entries, dictionary = entries_of(spark, sf_dir, "strength")
    return svd.decompose(entries, dictionary, k or dictionary.count())


@query(f"WITH {INTERACTIONS_SQL} SELECT round(sum(strength * strength), 2) AS energy FROM interactions")
def svd_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared singular values add up to the squared entries."""
    values = _decomposed(spark, sf_dir, None).values
    return values.agg(F.round(F.sum(F.col("s") * F.col("s")), 2).alias("energy"))


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, item_id, strength AS reconstructed FROM interactions")
def svd_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all components, U diag(s) V^T gives every entry back."""
    d = _decomposed(spark, sf_dir, None)
    cells = interactions(spark, sf_dir).select("user_id", "item_id")
    return svd.reconstruct_cells(d, cells).withColumn("reconstructed", F.round("reconstructed", 6))


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, round(sum(strength * strength), 3) AS energy FROM interactions GROUP BY 1")
def svd_user_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of U diag(s) are as long as the users' rows of the matrix."""
    rows = svd.user_clusters(_decomposed(spark, sf_dir, None))
    squares = F.aggregate("values", F.lit(0.0), lambda total, x: total + x * x)
    return rows.select("user_id", F.round(squares, 3).alias("energy"))


@query(f"WITH {INTERACTIONS_SQL} SELECT item_id, round(sum(strength * strength), 3) AS energy FROM interactions GROUP BY 1")
def svd_item_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of diag(s) V^T are as long as the items' columns of the matrix."""
    rows = svd.item_clusters(_decomposed(spark, sf_dir, None))
    return rows.groupBy("item_id").agg(F.round(F.sum(F.col("value") * F.col("value")), 3).alias("energy"))


def _factors_sql(key: str) -> str:
    return f"""WITH {INTERACTIONS_SQL}
SELECT DISTINCT {key}, CAST(component AS INTEGER) AS component, TRUE AS holds FROM interactions, range(3) AS c(component)"""


def _holding(misfits: DataFrame, d: svd.Decomposition) -> DataFrame:
    holds = F.col("misfit") <= 1e-6 * d.singular_values[0]
    return misfits.select(misfits.columns[0], "component", holds.alias("holds"))


@query(_factors_sql("user_id"))
def svd_user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' factors of the three largest components: A v = s u holds for every user."""
    d = _decomposed(spark, sf_dir, 3)
    return _holding(svd.misfits(d)[0], d)


@query(_factors_sql("item_id"))
def svd_item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' factors of the three largest components, transposed: A^T u = s v holds for every item."""
    d = _decomposed(spark, sf_dir, 3)
    found = _holding(svd.misfits(d)[1], d)
    turned = svd.transpose(d.items, "item_id", "v").select("item_id", F.col("column").alias("component"))
    return found.join(turned, ["item_id", "component"])


@query()
def svd_reconstruct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rows of the best rank-3 approximation."""
    return svd.reconstruct_rows(_decomposed(spark, sf_dir, 3))


def _svd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rank_lookalikes(interactions(spark, sf_dir), "active_days", TARGET_ITEM, k=30)


@query()
def svd_lookalike_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on the main component of the target item; its users on more than one day are the targets."""
    return lookalike.sweep(_svd_scores(spark, sf_dir))


@query()
def svd_potential_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 20 percent by singular vector that do not use the target item yet."""
    players = players_of(modeling(spark, sf_dir), TARGET_ITEM)
    return jobs.potential_lookalikes(_svd_scores(spark, sf_dir), players, TARGET_ITEM, 20)
