"""Topics over count vectors."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propense.sources.staging import shared_dir


def count_vectors(counts: DataFrame, column: str = "counts") -> DataFrame:
    """An array column of counts as the `features` vector column."""
    return counts.withColumn("features", array_to_vector(column)).drop(column)


def fit(vectors: DataFrame, k: int = 3, iterations: int = 20, seed: int = 17) -> LDAModel:
    """Latent Dirichlet allocation by expectation maximisation."""
    shared_dir(vectors.sparkSession)
    return LDA(k=k, maxIter=iterations, optimizer="em", seed=seed, checkpointInterval=10).fit(vectors)


def topic_terms(model: LDAModel, spark) -> DataFrame:
    """`topic, term, weight` for every topic and term: k x vocabulary numbers, as in the model's matrix."""
    rows = model.topicsMatrix().toArray().tolist()
    table = spark.createDataFrame(list(enumerate(rows)), "term int, weights array<double>")
    return table.select(F.posexplode("weights").alias("topic", "weight"), "term").select("topic", "term", "weight")
