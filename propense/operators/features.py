"""Item dictionary and user feature vectors."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propense.operators.joins import lookup_join
from propense.operators.quantiles import dense_index
from propense.sources.staging import stage
from propense.sources.tables import vector_schema


def item_dictionary(interactions: DataFrame) -> DataFrame:
    """`item_id, item_index`: a dense column number in ascending id order, of 32 bits as vectors have them."""
    numbered = dense_index(interactions.select("item_id").distinct(), "item_id", "item_index")
    return numbered.withColumn("item_index", F.col("item_index").cast("int"))


def reindex(interactions: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Replace wide ids by dense ones: the table under new ids and the dictionary `column, dense`."""
    dictionary = stage(dense_index(interactions.select(column).distinct(), column, "dense"), "ids")
    joined = lookup_join(interactions, dictionary, column, "inner")
    columns = [F.col("dense").alias(column) if c == column else F.col(c) for c in interactions.columns]
    return joined.select(*columns), dictionary


def indexed_entries(interactions: DataFrame, dictionary: DataFrame, value: str) -> DataFrame:
    """Matrix entries `user_id, item_index, value`; repeated cells are summed and null counts as 0."""
    cells = interactions.groupBy("user_id", "item_id").agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("value")
    )
    return lookup_join(cells, dictionary, "item_id", "inner").select("user_id", "item_index", "value")


def user_vectors(entries: DataFrame, n_items: int, vector_type: T.DataType | None = None) -> DataFrame:
    """Pivot entries to one sparse vector per user: `user_id, features`.

    A user has one entry per item at most, so a group is bounded by the size of
    the dictionary. The rows are written in the vector type's own storage form
    and read back as vectors, which keeps the pivot free of Python.
    """
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(n_items).alias("size"),
        F.col("cells.item_index").alias("indices"),
        F.col("cells.value").alias("values"),
    )
    rows = (
        entries.groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("item_index", "value"))).alias("cells"))
        .select("user_id", sparse.alias("features"))
    )
    return stage(rows, "vectors", vector_schema("user_id", vector_type=vector_type or VectorUDT()))


def vector_cells(vectors: DataFrame, column: str, key: str = "user_id") -> DataFrame:
    """`user_id, item_index, value`: the cells that a vector stores, those of a sparse one without the zeros between them."""
    stored = F.unwrap_udt(column)
    # A dense vector stores no indices.
    values = stored["values"]
    places = F.coalesce(stored["indices"], F.sequence(F.lit(0), F.size(values) - 1))
    cells = vectors.select(key, F.explode(F.arrays_zip(places.alias("item_index"), values.alias("value"))).alias("cell"))
    return cells.select(key, "cell.item_index", "cell.value")


def vector_element(vector: Column, index: int) -> Column:
    """Element of a vector column; null outside of it. A sparse vector is searched as it is stored, and not written out."""
    stored = F.unwrap_udt(vector)
    place = F.array_position(stored["indices"], F.lit(index))
    within = (F.lit(index) >= 0) & (stored["size"] > index)
    sparse = F.when(place > 0, F.get(stored["values"], (place - 1).cast("int"))).when(within, F.lit(0.0))
    return F.when(stored["indices"].isNull(), F.get(stored["values"], F.lit(index))).otherwise(sparse)


def users_above(entries: DataFrame, index: int, bound: float) -> DataFrame:
    """Users whose value in one column is above the bound, read from the entries without a pivot."""
    return entries.where((F.col("item_index") == index) & (F.col("value") > bound)).select("user_id")
