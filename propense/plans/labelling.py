"""Rating rules and quintile scores over the interaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.functions.labels import (
    active_at_least,
    active_more_than,
    active_or_frequent,
    paid,
    zero_if_null,
)
from propense.operators.quintiles import PARTS, cut_points, quintile_scores
from propense.plans.fixtures import INTERACTIONS_SQL, SEED, draw_sql, interactions
from propense.plans.registry import query
from propense.operators.splits import random_split
from propense.sources.staging import stage


@query(f"""WITH {INTERACTIONS_SQL}
SELECT user_id, item_id, CASE WHEN revenue > 0 THEN 1.0e0 ELSE 0.0e0 END AS rating FROM interactions""")
def label_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select("user_id", "item_id", paid(F.col("revenue")).alias("rating"))


@query(f"""WITH {INTERACTIONS_SQL}
SELECT user_id, item_id, CASE WHEN active_days > 1 THEN 1.0e0 ELSE 0.0e0 END AS more_than_one,
       CASE WHEN active_days >= 2 THEN 1.0e0 ELSE 0.0e0 END AS at_least_two,
       CASE WHEN active_days >= 7 THEN 1.0e0 ELSE 0.0e0 END AS at_least_seven FROM interactions""")
def label_login_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = zero_if_null(F.col("active_days"))
    return interactions(spark, sf_dir).select(
        "user_id",
        "item_id",
        active_more_than(days, 1).alias("more_than_one"),
        active_at_least(days, 2).alias("at_least_two"),
        active_at_least(days, 7).alias("at_least_seven"),
    )


@query(f"""WITH {INTERACTIONS_SQL}
SELECT user_id, item_id, CASE WHEN active_days > 1 OR strength / active_days > 30 THEN 1.0e0 ELSE 0.0e0 END AS rating
FROM interactions""")
def label_or_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than one active day, or more than 30 units a day."""
    rate = F.col("strength") / F.col("active_days") / 30
    return interactions(spark, sf_dir).select(
        "user_id", "item_id", active_or_frequent(F.col("active_days"), rate).alias("rating")
    )


@query(f"""WITH {INTERACTIONS_SQL}
SELECT user_id, item_id, strength AS rating FROM interactions""")
def label_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select("user_id", "item_id", F.col("strength").cast("double").alias("rating"))


@query(f"""WITH {INTERACTIONS_SQL}
SELECT user_id, item_id, coalesce(revenue, 0) AS revenue FROM interactions""")
def null_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select("user_id", "item_id", zero_if_null(F.col("revenue")).alias("revenue"))


_ACTIVITY_SQL = f"""{INTERACTIONS_SQL},
activity AS (SELECT user_id, item_id, active_days, coalesce(revenue, 0) AS revenue FROM interactions)"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select(
        "user_id", "item_id", "active_days", zero_if_null(F.col("revenue")).alias("revenue")
    )


def _cuts_sql(source: str) -> str:
    """CTEs with the values at positions floor(n / 5) * j of both columns."""
    parts = []
    for column in ("active_days", "revenue"):
        parts.append(f"""{column}_cuts AS (
  SELECT {", ".join(f"max(CASE WHEN pos = size * {j} THEN {column} END) AS c{j}" for j in range(1, 5))}
  FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS pos, count(*) OVER () // 5 AS size FROM {source}))""")
    return ",\n".join(parts)


def _bucket_sql(column: str, base: int) -> str:
    whens = " ".join(
        f"WHEN {column} <= (SELECT c{j} FROM {column}_cuts) THEN {base + j - 1}" for j in range(1, 5)
    )
    return f"(CASE {whens} ELSE {base + 4} END)"


@query(f"""WITH {_ACTIVITY_SQL}, {_cuts_sql("activity")}
SELECT 'active_days' AS "column", 1 AS part, CAST(c1 AS DOUBLE) AS cut FROM active_days_cuts
UNION ALL SELECT 'active_days', 2, c2 FROM active_days_cuts UNION ALL SELECT 'active_days', 3, c3 FROM active_days_cuts
UNION ALL SELECT 'active_days', 4, c4 FROM active_days_cuts UNION ALL SELECT 'revenue', 1, c1 FROM revenue_cuts
UNION ALL SELECT 'revenue', 2, c2 FROM revenue_cuts UNION ALL SELECT 'revenue', 3, c3 FROM revenue_cuts
UNION ALL SELECT 'revenue', 4, c4 FROM revenue_cuts""")
def quintile_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_activity(spark, sf_dir), "activity")
    cuts = [
        (column, part, cut)
        for column, points in cut_points(rows, ["active_days", "revenue"]).items()
        for part, cut in enumerate(points, start=1)
    ]
    return spark.createDataFrame(cuts, "column string, part int, cut double")


def _scores_sql(base: int, part: int) -> str:
    return f"""WITH {_ACTIVITY_SQL},
part AS (SELECT * FROM activity WHERE CASE WHEN {draw_sql(SEED, "user_id", "item_id")} < 1717986918 THEN 0 ELSE 1 END = {part}),
{_cuts_sql("part")}
SELECT user_id, item_id, revenue,
       round({_bucket_sql("active_days", base)} / 100.0e0 + {_bucket_sql("revenue", base)}, 4) AS score FROM part"""


def _scores(spark: SparkSession, sf_dir: str, base: int, part: int) -> DataFrame:
    """One side of a 0.8 / 0.2 split, scored by its own quintiles."""
    side = stage(random_split(_activity(spark, sf_dir), [0.8, 0.2], SEED)[part], "activity")
    scored = quintile_scores(side, "active_days", "revenue", base)
    return scored.select("user_id", "item_id", "revenue", F.round("score", 4).alias("score"))


@query(_scores_sql(1, 0))
def quintile_scores_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training scores count quintiles from 1."""
    return _scores(spark, sf_dir, 1, 0)


@query(_scores_sql(0, 1))
def quintile_scores_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores count quintiles from 0 and use the test set's own cut points."""
    return _scores(spark, sf_dir, 0, 1)


assert PARTS == 5  # the SQL above spells out four cut points
