"""Sink queries: what is written and read back is what the SQL says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.functions import parsing
from propense.plans.fixtures import INTERACTIONS_SQL, RATED_SQL, interactions, rated
from propense.plans.ingest import EVENT_TYPES, event_counts
from propense.plans.registry import query
from propense.sources.sinks import factor_line, matrix_line, write_csv, write_lines, write_table
from propense.sources.staging import stage, staging_path
from propense.sources.text import read_lines


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, item_id, revenue, active_days, strength FROM interactions")
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "sink")
    write_table(interactions(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(f"WITH {RATED_SQL} SELECT user_id, item_id, rating FROM rated")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "sink")
    write_csv(rated(spark, sf_dir), path, "\t")
    return spark.read.schema("user_id bigint, item_id bigint, rating double").option("sep", "\t").csv(path)


@query(f"WITH {RATED_SQL} SELECT rating, count(*) AS count FROM rated WHERE rating > 0 GROUP BY 1")
def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write replaces the first."""
    path = staging_path(spark, "sink")
    rows = stage(rated(spark, sf_dir), "rated")
    write_table(rows, path)
    write_table(rows.where(F.col("rating") > 0), path)
    return spark.read.parquet(path).groupBy("rating").count()


def _per_kind(template: str) -> str:
    return ", ".join(template.format(kind=k) for k in EVENT_TYPES)


_COUNT = "count(*) FILTER (WHERE event_type = '{kind}')"


@query(f"""SELECT concat_ws(',', user_id, {_per_kind("CAST(" + _COUNT + " AS DOUBLE)")}) AS value
FROM events GROUP BY user_id""")
def sink_factor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a matrix as `id,v0,v1,...` text."""
    path = staging_path(spark, "sink")
    rows = parsing.parse_counts(event_counts(spark, sf_dir))
    write_lines(rows, factor_line(F.col("user_id"), F.col("counts")), path)
    return read_lines(spark, path)


@query(f"""SELECT value, count(*) AS count FROM (
  SELECT concat_ws(', ', {_per_kind("printf('%.4f', " + _COUNT + " / 7.0e0)")}) AS value FROM events GROUP BY user_id)
GROUP BY 1""")
def sink_matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a matrix with four decimals; a second write leaves the existing output alone."""
    path = staging_path(spark, "sink")
    rows = parsing.parse_counts(event_counts(spark, sf_dir))
    line = matrix_line(F.transform("counts", lambda c: c / 7))
    write_lines(rows, line, path, mode="ignore")
    write_lines(rows, F.lit("replaced"), path, mode="ignore")
    return read_lines(spark, path).groupBy("value").count()
