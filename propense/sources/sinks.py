"""Writers for predictions, audiences, factors, metrics and models."""

from __future__ import annotations

from pyspark.ml.clustering import DistributedLDAModel, KMeansModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.operators import recommend

_MODELS = {"kmeans": KMeansModel, "lda": DistributedLDAModel}


def rating_line() -> Column:
    """`user<TAB>item<TAB>rating<TAB>prediction`, the prediction with four decimals."""
    return F.concat_ws(
        "\t",
        F.col("user_id").cast("string"),
        F.col("item_id").cast("string"),
        F.col("rating").cast("string"),
        F.format_string("%02.4f", "prediction"),
    )


def matrix_line(values: Column) -> Column:
    """A matrix row as `0.1234, 0.5678`."""
    return F.array_join(F.transform(values, lambda v: F.format_string("%4.4f", v)), ", ")


def factor_line(key: Column, values: Column) -> Column:
    """`key,v0,v1,...`"""
    return F.concat_ws(",", key.cast("string"), F.array_join(values.cast("array<string>"), ","))


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "overwrite") -> None:
    """One text line per row. `mode="ignore"` keeps an existing output."""
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("sep", separator).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def publish(df: DataFrame, view: str, path: str) -> None:
    """Register a view for SQL users and store everything it selects."""
    df.createOrReplaceTempView(view)
    df.sparkSession.table(view).write.mode("overwrite").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add the metrics rows of a finished trial to a metrics table."""
    metrics.write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    """Store a model; a collaborative-filtering one as its two tables of factors and its settings."""
    if isinstance(model, recommend.Model):
        recommend.save(model, path)
    else:
        model.write().overwrite().save(path)


def load_model(kind: str, path: str):
    """Load a stored `als`, `kmeans` or `lda` model."""
    return recommend.load(SparkSession.active(), path) if kind == "als" else _MODELS[kind].load(path)
