"""Evaluation queries on deterministic predictors, so that every number has its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from propense.functions.labels import paid
from propense.operators import auc, evaluation
from propense.operators.joins import lookup_join
from propense.operators.negatives import sample_negatives
from propense.operators.popularity import popularity, predict_popularity
from propense.operators.splits import with_fold, with_split, with_stratified_split
from propense.operators.trials import best, choices, grid, linear, log_spaced, random_trials, ranked, run_trials
from propense.plans.fixtures import (
    CHANNEL,
    MODELING_SQL,
    RATED_SQL,
    SEED,
    TARGET_ITEM,
    draw_sql,
    modeling,
    rated,
)
from propense.plans.ingest import lines_to_files
from propense.plans.registry import query
from propense.plans.splitting import NEGATIVES_SQL, held_out, split_sql
from propense.sources.sinks import append_metrics, rating_line, write_lines
from propense.sources.staging import stage, staging_path
from propense.sources.text import read_lines

# --- a predictor with an exact sign: does an item sell above the average rate?


def item_counts(train: DataFrame) -> DataFrame:
    """`item_id, payers, pairs` of the training rows."""
    counts = train.groupBy("item_id").agg(
        F.sum("rating").cast("bigint").alias("payers"), F.count("*").alias("pairs")
    )
    return stage(counts, "item_counts")


def lift(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Prediction above zero where an item's share of payers exceeds the overall share."""
    items = item_counts(train)
    payers, rows = items.agg(F.sum("payers"), F.sum("pairs")).first()
    value = _product("payers", F.lit(rows)) - _product("pairs", F.lit(payers))
    valued = items.select("item_id", value.cast("double").alias("_value"))
    return lookup_join(pairs, valued, "item_id").select(
        *pairs.columns, F.coalesce("_value", F.lit(0.0)).alias("prediction")
    )


def _product(left: str, right: Column) -> Column:
    """An exact product of two counts, which may exceed 64 bits."""
    return F.col(left).cast("decimal(19,0)") * right.cast("decimal(18,0)")


def _lift_sql(train: str, test: str, name: str, columns: str = "h.user_id, h.item_id, h.rating") -> str:
    """CTE `name` with predictions for `test` from `train`."""
    return f"""{name} AS (
  SELECT {columns}, CAST(coalesce(i.payers * t.n - t.payers * i.n, 0) AS DOUBLE) AS prediction
  FROM {test} h LEFT JOIN (SELECT item_id, CAST(sum(rating) AS BIGINT) AS payers, count(*) AS n FROM {train} GROUP BY 1) i
    ON h.item_id = i.item_id
  CROSS JOIN (SELECT CAST(sum(rating) AS BIGINT) AS payers, count(*) AS n FROM {train}) t)"""


PARTED_SQL = f"""{RATED_SQL}, parted AS (SELECT *, {split_sql([0.9])} AS split FROM rated),
train AS (SELECT user_id, item_id, rating FROM parted WHERE split = 0),
test AS (SELECT user_id, item_id, rating FROM parted WHERE split = 1)"""

_COUNTS = """CAST(count(*) FILTER (WHERE rating > 0 AND prediction > 0) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE rating <= 0 AND prediction > 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE rating > 0 AND prediction <= 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE rating <= 0 AND prediction <= 0) AS BIGINT) AS tn"""


def _div(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} = 0 THEN CAST('NaN' AS DOUBLE) ELSE ({top}) / CAST({bottom} AS DOUBLE) END)"


_P, _R = _div("tp", "(tp + fp)"), _div("tp", "(tp + fn)")
_METRICS_SQL = {
    "accuracy": _div("tp + tn", "(tp + fp + fn + tn)"),
    "precision": _P,
    "recall": _R,
    "fallout": _div("fp", "(fp + tn)"),
    "sensitivity": _R,
    "specificity": _div("tn", "(fp + tn)"),
    "f": f"(CASE WHEN tp = 0 THEN CAST('NaN' AS DOUBLE) ELSE 2 * {_P} * {_R} / ({_P} + {_R}) END)",
}
_METRICS = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _METRICS_SQL.items())


def rounded(metrics: DataFrame, places: int = 6) -> DataFrame:
    return metrics.withColumns({m: F.round(m, places) for m in evaluation.METRICS})


@query(f"""WITH {PARTED_SQL}, {_lift_sql("train", "test", "predicted")}, counts AS (SELECT {_COUNTS} FROM predicted)
SELECT tp, fp, fn, tn, {_METRICS} FROM counts""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = held_out(spark, sf_dir)
    return rounded(evaluation.evaluate(lift(train, test)))


@query(f"""WITH {RATED_SQL}, parted AS (SELECT *, {split_sql([0.8, 0.9])} AS split FROM rated),
train AS (SELECT * FROM parted WHERE split = 0), test AS (SELECT * FROM parted WHERE split > 0),
{_lift_sql("train", "test", "predicted", "h.split, h.rating")},
counts AS (SELECT split, {_COUNTS} FROM predicted GROUP BY 1)
SELECT split, tp, fp, fn, tn, {_METRICS} FROM counts""")
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training set, two independent test sets."""
    parts = stage(with_split(rated(spark, sf_dir), [0.8, 0.1, 0.1], SEED), "parts", partition_by="split")
    return rounded(evaluation.evaluate(lift(parts.where("split = 0"), parts.where("split > 0")), ["split"]))


_STRATA_SQL = f"""{RATED_SQL}, strata AS (
  SELECT *, CASE WHEN item_id = {TARGET_ITEM} THEN 'target' ELSE 'other' END AS population,
         CASE WHEN item_id = {TARGET_ITEM} THEN {split_sql([0.9])} ELSE {split_sql([0.99])} END AS split FROM rated),
train AS (SELECT * FROM strata WHERE split = 0), test AS (SELECT * FROM strata WHERE split = 1)"""


@query(f"""WITH {_STRATA_SQL}, {_lift_sql("train", "test", "predicted", "h.population, h.rating")},
counts AS (SELECT population, {_COUNTS} FROM predicted GROUP BY 1)
SELECT population, tp, fp, fn, tn, {_METRICS} FROM counts""")
def metrics_by_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and other rows are held out and evaluated separately, in one pass."""
    strata = with_stratified_split(rated(spark, sf_dir), TARGET_ITEM, [0.9, 0.1], [0.99, 0.01], SEED)
    parts = stage(strata, "strata", partition_by="split")
    predicted = lift(parts.where("split = 0"), parts.where("split = 1").drop("split"))
    return rounded(evaluation.evaluate(predicted, ["population"]))


@query(f"""WITH {PARTED_SQL}, shares AS (SELECT item_id, avg(rating) AS share FROM train GROUP BY 1)
SELECT round(avg(pow(rating - coalesce(share, 0), 2)), 6) AS mse FROM test LEFT JOIN shares USING (item_id)""")
def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of predicting an item's share of payers."""
    _, train, test = held_out(spark, sf_dir)
    shares = stage(train.groupBy("item_id").agg(F.avg("rating").alias("share")), "shares")
    predicted = lookup_join(test, shares, "item_id").withColumn("prediction", F.coalesce("share", F.lit(0.0)))
    return evaluation.mean_squared_error(predicted).select(F.round("mse", 6).alias("mse"))


_FOLD_PREDICTIONS = ",\n".join(
    f"""base{i} AS (SELECT item_id, rating FROM base UNION ALL SELECT item_id, rating FROM folded WHERE fold <> {i}),
test{i} AS (SELECT * FROM folded WHERE fold = {i}),
{_lift_sql(f"base{i}", f"test{i}", f"predicted{i}", "h.fold, h.rating")}"""
    for i in range(4)
)
_FOLDS_SQL = f"""{MODELING_SQL},
both_channels AS (SELECT user_id, item_id, channel, CASE WHEN revenue > 0 THEN 1.0e0 ELSE 0.0e0 END AS rating FROM modeling),
base AS (SELECT * FROM both_channels WHERE channel <> {CHANNEL}),
folded AS (SELECT *, {split_sql([0.25, 0.5, 0.75])} AS fold FROM both_channels WHERE channel = {CHANNEL}),
{_FOLD_PREDICTIONS},
counts AS (SELECT fold, {_COUNTS} FROM ({" UNION ALL ".join(f"SELECT * FROM predicted{i}" for i in range(4))}) GROUP BY 1),
folds AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in _METRICS_SQL.items())} FROM counts)"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of four folds over one channel; the other channel is in every training set.

    The item counts of all training sets come from one aggregation: a fold's
    training counts are the totals without the fold's own.
    """
    both = modeling(spark, sf_dir).select("user_id", "item_id", "channel", paid(F.col("revenue")).alias("rating"))
    own = F.when(F.col("channel") == CHANNEL, F.col("fold")).otherwise(F.lit(-1))
    both = stage(with_fold(both, 4, SEED).withColumn("fold", own).drop("channel"), "folds")
    per_fold = both.groupBy("item_id", "fold").agg(F.sum("rating").cast("bigint").alias("p"), F.count("*").alias("n"))
    per_fold = stage(per_fold, "fold_counts")

    def held_back(column: str, fold: Column) -> Column:
        return F.sum(column) - F.sum(F.when(F.col("fold") == fold, F.col(column)).otherwise(0))

    numbers = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    by_item = per_fold.select("*", numbers.alias("of")).groupBy("item_id", "of")
    items = by_item.agg(held_back("p", F.col("of")).alias("payers"), held_back("n", F.col("of")).alias("pairs"))
    items = stage(items.withColumnRenamed("of", "fold"), "fold_items")
    overall = items.groupBy("fold").agg(F.sum("payers").alias("all_payers"), F.sum("pairs").alias("all_pairs"))
    value = _product("payers", F.col("all_pairs")) - _product("pairs", F.col("all_payers"))
    valued = items.join(F.broadcast(overall), "fold").select("item_id", "fold", value.cast("double").alias("_value"))
    tested = lookup_join(both.where(F.col("fold") >= 0), valued, ["item_id", "fold"])
    return evaluation.evaluate(tested.withColumn("prediction", F.coalesce("_value", F.lit(0.0))), ["fold"])


@query(f"""WITH {_FOLDS_SQL} SELECT round(avg(recall), 6) AS mean_recall,
round(max(recall) - min(recall), 6) AS recall_spread FROM folds""")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluation.fold_summary(_folds(spark, sf_dir))
    return summary.select(*[F.round(c, 6).alias(c) for c in summary.columns])


# A metric without a value is NaN, which the two engines spell differently.
_METRICS_TEXT = (
    "replace(replace(printf('%.4f,%.4f,  %.4f,%.4f,%.4f,%.4f,%.4f', "
    + ", ".join(f"round({name}, 4)" for name in evaluation.METRICS)
    + "), '-nan', 'NaN'), 'nan', 'NaN')"
)


@query(f"""WITH {_FOLDS_SQL}
SELECT fold, printf('%2d,%.4f,%.4f,%2d,%07.4f,%07.4f', 7, round(mean, 4), round(spread, 4), 12, 0.1662, 32.6604)
  || ',' || {_METRICS_TEXT} AS line
FROM folds CROSS JOIN (SELECT avg(recall) AS mean, max(recall) - min(recall) AS spread FROM folds)""")
def fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report line per fold, headed by the mean and spread over the folds."""
    folds = stage(_folds(spark, sf_dir), "folds")
    summary = evaluation.fold_summary(folds).first()
    named = folds.withColumns(
        {
            "trial": F.lit(7),
            "rank": F.lit(12),
            "reg": F.lit(0.1662),
            "alpha": F.lit(32.6604),
            "mean_recall": F.lit(summary["mean_recall"]),
            "recall_spread": F.lit(summary["recall_spread"]),
        }
    )
    return named.select("fold", evaluation.fold_line().alias("line"))


@query(f"""WITH {PARTED_SQL}, {_lift_sql("train", "test", "predicted")}
SELECT user_id || chr(9) || item_id || chr(9) || rating || chr(9) || printf('%.4f', prediction) AS value FROM predicted""")
def rated_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined to predictions, in key order, as tab-separated text files read back."""
    _, train, test = held_out(spark, sf_dir)
    predictions = lift(train, test).drop("rating")
    joined = evaluation.join_facts(predictions, test).orderBy("user_id", "item_id")
    path = staging_path(spark, "rated")
    write_lines(joined, rating_line(), path)
    return read_lines(spark, path)


# --- mean per-user AUC of popularity over held-out and sampled negative items

_AUC_SQL = f"""{RATED_SQL}, {NEGATIVES_SQL},
popular AS (SELECT item_id, sum(rating) AS score FROM rated WHERE {split_sql([0.9])} = 0 GROUP BY 1),
p AS (SELECT user_id, coalesce(score, 0) AS score FROM held LEFT JOIN popular USING (item_id)),
n AS (SELECT user_id, coalesce(score, 0) AS score FROM negatives LEFT JOIN popular USING (item_id)),
by_user AS (SELECT p.user_id, count(*) FILTER (WHERE p.score > n.score) AS correct,
  count(*) FILTER (WHERE p.score = n.score) AS tied, count(*) AS pairs
  FROM p JOIN n ON p.user_id = n.user_id GROUP BY 1)"""


def _popularity_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, train, held = held_out(spark, sf_dir)
    popular = stage(popularity(train), "popular")
    return predict_popularity(held, popular), predict_popularity(sample_negatives(held, rows, SEED), popular)


@query(f"""WITH {_AUC_SQL} SELECT user_id, CAST(correct AS DOUBLE) AS correct, CAST(pairs AS DOUBLE) AS pairs,
correct / pairs AS auc FROM by_user""")
def auc_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc.user_auc(*_popularity_sides(spark, sf_dir))


@query(f"WITH {_AUC_SQL} SELECT round(avg(correct / pairs), 6) AS auc, count(*) AS users FROM by_user")
def auc_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc.mean_auc(*_popularity_sides(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {_AUC_SQL} SELECT round(avg((correct + tied / 2.0e0) / pairs), 6) AS auc, count(*) AS users FROM by_user""")
def auc_half_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc.mean_auc(*_popularity_sides(spark, sf_dir), ties="half").withColumn("auc", F.round("auc", 6))


# --- random search over a grid with a smoothed item rate as the model

TRIALS = 6


def _trial_grid(spark: SparkSession) -> DataFrame:
    points = grid(
        spark, linear("rank", "2", "50", "2"), choices("reg", 0.0001, 0.05, 0.1), log_spaced("alpha", 0.01, 50, 20)
    )
    return points.withColumn("alpha", F.round("alpha", 6))


_TRIALS_SQL = f"""trials AS (
  SELECT row_number() OVER (ORDER BY {draw_sql(SEED, "point")}, point) - 1 AS trial, *
  FROM (SELECT point, 2 + 2 * (point // 60) AS rank, [0.0001e0, 0.05e0, 0.1e0][(point // 20) % 3 + 1] AS reg,
               round(exp(ln(0.01e0) + (point % 20) * ((ln(50e0) - ln(0.01e0)) / 20)), 6) AS alpha
        FROM (SELECT unnest(range(24 * 3 * 20)) AS point))
  ORDER BY trial LIMIT {TRIALS})"""

_SEARCH_SQL = f"""{PARTED_SQL}, {_TRIALS_SQL},
items AS (SELECT item_id, CAST(sum(rating) AS BIGINT) AS payers, count(*) AS n FROM train GROUP BY 1),
overall AS (SELECT CAST(sum(payers) AS DOUBLE) / sum(n) AS share FROM items),
predicted AS (SELECT t.*, h.rating, CASE WHEN n >= t.rank
    THEN (payers + t.alpha * share) / (n + t.alpha) - share * (1 + t.reg) ELSE -1 END AS prediction
  FROM test h LEFT JOIN items i ON h.item_id = i.item_id CROSS JOIN trials t CROSS JOIN overall),
counts AS (SELECT trial, point, rank, reg, alpha, {_COUNTS} FROM predicted GROUP BY 1, 2, 3, 4, 5)"""


def _smoothed(share: float, trial: Row) -> Column:
    """An item's smoothed share of payers against the overall one; rare items are never predicted."""
    smoothed = (F.col("payers") + F.lit(trial["alpha"] * share)) / (F.col("pairs") + F.lit(trial["alpha"]))
    enough = F.col("pairs") >= trial["rank"]
    return F.when(enough, smoothed - F.lit(share * (1 + trial["reg"]))).otherwise(F.lit(-1.0))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = held_out(spark, sf_dir)
    items = item_counts(train)
    payers, pairs = items.agg(F.sum("payers"), F.sum("pairs")).first()
    with_items = stage(lookup_join(test, items, "item_id"), "test_items")

    def one(trial: Row) -> DataFrame:
        predicted = with_items.withColumn("prediction", _smoothed(payers / pairs, trial))
        return rounded(evaluation.evaluate(predicted))

    return run_trials(spark, random_trials(_trial_grid(spark), TRIALS, SEED), one, complete=True)


@query(f"WITH {_SEARCH_SQL} SELECT trial, point, rank, reg, alpha, tp, fp, fn, tn, {_METRICS} FROM counts")
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of randomly chosen grid points on the held-out rows."""
    return _search(spark, sf_dir)


@query(f"""WITH {_SEARCH_SQL} SELECT trial, rank, reg, alpha, accuracy FROM (
SELECT trial, rank, reg, alpha, {_METRICS} FROM counts) ORDER BY accuracy DESC, trial LIMIT 1""")
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(_search(spark, sf_dir), "accuracy").select("trial", "rank", "reg", "alpha", "accuracy")


@query(f"""WITH {_SEARCH_SQL} SELECT row_number() OVER (ORDER BY accuracy DESC, trial) AS place, trial, accuracy FROM (
SELECT trial, {_METRICS} FROM counts)""")
def ranked_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials from the best down; the handful of trials is numbered in order."""
    rows = ranked(_search(spark, sf_dir), "accuracy").select("trial", "accuracy")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "trial")).cast("bigint"))


@query(f"""WITH {_SEARCH_SQL} SELECT trial, point, rank, reg, alpha, tp, fp, fn, tn, {_METRICS} FROM counts""")
def metrics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trial's metrics appended to one table as it is reported."""
    path = staging_path(spark, "metrics")
    results = stage(_search(spark, sf_dir), "search")
    for trial in range(TRIALS):
        append_metrics(results.where(F.col("trial") == trial), path)
    return spark.read.parquet(path)


_LINES_SQL = f"""WITH {_SEARCH_SQL}, metrics AS (
  SELECT trial, rank, reg, alpha, tp, {", ".join(f"{sql} AS {name}" for name, sql in _METRICS_SQL.items())} FROM counts)
SELECT printf('%6d,%2d,%07.4f,%07.4f', trial, rank, round(reg, 4), round(alpha, 4)) || ',' || {_METRICS_TEXT} AS value
FROM metrics"""


@query(_LINES_SQL)
def trial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines of all trials, through text files."""
    results = _search(spark, sf_dir)
    return read_lines(spark, lines_to_files(results.select(evaluation.trial_line().alias("value")), "report"))
