"""Joins against lookup tables that hold up when one key owns much of the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propense.limits import BROADCAST_BYTES, BROADCAST_ROWS, HOT_SHARE, SALTS, SKETCHED_KEYS


# Types whose values take eight bytes at most; a decimal takes sixteen.
_FLAT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, with all that it holds. A type that is not known here counts as its text form."""
    if isinstance(kind, _FLAT):
        return F.lit(16)
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, _FLAT):
            return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)) * 16 + 24
        held = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType).cast("long"))
        return F.coalesce(held, F.lit(0)) + 24
    if isinstance(kind, T.MapType):
        keys = _width(F.map_keys(value), T.ArrayType(kind.keyType))
        return keys + _width(F.map_values(value), T.ArrayType(kind.valueType)) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.UserDefinedType):
        # Imported here: Python workers load this module, and would hold the machine-learning package as well.
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.linalg import VectorUDT

        if isinstance(kind, VectorUDT):
            return F.coalesce(F.size(vector_to_array(value)), F.lit(0)) * 16 + 24
    return F.coalesce(F.octet_length(value.cast("string")), F.lit(0)) * 16 + 16


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is proven small: all its rows are counted and their bytes added up, nested ones too.

    One partial aggregation; run it on tables that are cheap to scan, such as staged ones.
    """
    widths = sum((_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in small.schema.fields), F.lit(8))
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(widths), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that own more than `share` of the rows: at most `2 / share`, none missing.

    One aggregation keeps a sketch of the most frequent keys, whose size follows
    from the share alone, so nothing is staged and no table of all keys is made.
    The sketch counts too few rows of a key, by a known share of all; a key that
    is taken in for that is salted as well, which changes no result.
    """
    top = F.expr(f"approx_top_k(_key, {math.ceil(2 / share)}, {SKETCHED_KEYS})")
    row = df.select(F.xxhash64(*on).alias("_key")).agg(F.count("*").alias("rows"), top.alias("top")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] > row["rows"] * (share - 4 / SKETCHED_KEYS)]


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    salts: int = SALTS,
    share: float = HOT_SHARE,
    hot: list[int] | None = None,
) -> DataFrame:
    """Shuffle join that spreads the big side's hot keys over `salts` tasks.

    Only the small side's rows of the hot keys are repeated. The salt is a hash
    of the row and of its input partition: a retried task puts its rows where
    the first attempt did, and even equal rows are spread. Rows without a key
    match nothing and are spread as well. `hot` gives the hot keys' hashes where
    they are known.
    """
    hashes = hot_keys(big, on, share) if hot is None else hot
    is_hot = F.xxhash64(*on).isin(hashes)
    row = F.xxhash64(*[f"`{c}`" for c in big.columns], F.spark_partition_id())
    keyless = F.lit(False)
    for key in on:
        keyless = keyless | F.col(key).isNull()
    spread = F.pmod(row, F.lit(salts)).cast("int")
    left = big.withColumn("_salt", F.when(is_hot | keyless, spread).otherwise(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", **bounds: int) -> DataFrame:
    """Join a table to a lookup table whose keys are unique.

    The lookup side is broadcast when it is proven small; otherwise both sides
    are shuffled, with the big side's hot keys salted. `how` is any join that
    keeps or drops rows of the big side: left, inner, left_semi, left_anti.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(small, **bounds):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how)
