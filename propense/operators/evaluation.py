"""Confusion matrix, derived metrics, errors, fold summaries and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of the metrics in reports.
METRICS = ("accuracy", "precision", "recall", "fallout", "sensitivity", "specificity", "f")


def _positive(value: Column, threshold: float) -> Column:
    """Strictly above the threshold. Spark sorts NaN above all numbers, so it is excluded."""
    return F.coalesce((value > threshold) & ~F.isnan(value.cast("double")), F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """Division with NaN for 0 / 0, as in floating point."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(float("nan")))


def confusion(predictions: DataFrame, by: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """`tp, fp, fn, tn` of `rating` (the fact) against `prediction`, in one pass over all groups.

    An empty set without groups gives one row of zeros.
    """
    fact = _positive(F.col("rating"), threshold)
    guess = _positive(F.col("prediction"), threshold)
    return predictions.groupBy(*(by or [])).agg(
        F.count_if(fact & guess).alias("tp"),
        F.count_if(~fact & guess).alias("fp"),
        F.count_if(fact & ~guess).alias("fn"),
        F.count_if(~fact & ~guess).alias("tn"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, fallout, sensitivity, specificity and F."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "fallout": ratio(fp, fp + tn),
            "sensitivity": ratio(tp, tp + fn),
            "specificity": ratio(tn, fp + tn),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    return rows.withColumn("f", ratio(2 * precision * recall, precision + recall))


def evaluate(predictions: DataFrame, by: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    return with_metrics(confusion(predictions, by, threshold))


def mean_squared_error(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)).alias("mse"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean recall over folds and the spread between the best and the worst."""
    return folds.agg(
        F.avg("recall").alias("mean_recall"), (F.max("recall") - F.min("recall")).alias("recall_spread")
    )


# The formats of the report lines below.
def metrics_text() -> Column:
    """The seven metrics with four decimals."""
    return F.format_string("%.4f,%.4f,  %.4f,%.4f,%.4f,%.4f,%.4f", *METRICS)


def trial_line(width: int = 6) -> Column:
    """`index,rank,lambda,alpha,` padded, then the metrics."""
    head = F.format_string(f"%{width}d,%2d,%07.4f,%07.4f", "trial", "rank", "reg", "alpha")
    return F.concat(head, F.lit(","), metrics_text())


def fold_line() -> Column:
    """`index,mean,spread,rank,lambda,alpha,` then the metrics of one fold."""
    head = F.format_string(
        "%2d,%.4f,%.4f,%2d,%07.4f,%07.4f", "trial", "mean_recall", "recall_spread", "rank", "reg", "alpha"
    )
    return F.concat(head, F.lit(","), metrics_text())


def join_facts(predictions: DataFrame, facts: DataFrame) -> DataFrame:
    """Predictions beside the facts of the same (user, item)."""
    return facts.select("user_id", "item_id", "rating").join(
        predictions.select("user_id", "item_id", "prediction"), ["user_id", "item_id"]
    )
