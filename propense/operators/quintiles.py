"""Quintile cut points, buckets and the composite engagement score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propense.operators.quantiles import count_values, select_ranks

PARTS = 5


def cut_points(df: DataFrame, columns: list[str], parts: int = PARTS) -> dict[str, list[float]]:
    """Per column, the values at positions `floor(n / parts) * j`, j = 1 .. parts - 1, of the sorted column.

    n counts the column's own values, without nulls and NaN. With fewer than
    `parts` of them there is no cut point and every row is lowest.
    """
    totals = count_values(df, columns)
    return select_ranks(df, {c: [totals[c] // parts * j for j in range(1, parts) if totals[c] >= parts] for c in columns}, totals=totals)


def cut_bucket(value: Column, cuts: list[float], base: int = 1) -> Column:
    """`base` plus the number of cut points below the value: ranges closed on the right."""
    if not cuts:
        return F.lit(base)
    result = F.when(value <= cuts[0], F.lit(base))
    for step, cut in enumerate(cuts[1:], start=1):
        result = result.when(value <= cut, F.lit(base + step))
    return result.otherwise(F.lit(base + len(cuts)))


def quintile_scores(df: DataFrame, days: str = "login_days", amount: str = "amount", base: int = 1) -> DataFrame:
    """Add `score` = amount quintile + login-day quintile / 100, quintiles from `base` up.

    The cut points come from the scored table itself; the raw columns stay.
    """
    cuts = cut_points(df, [days, amount])
    day_score = cut_bucket(F.col(days), cuts[days], base)
    amount_score = cut_bucket(F.col(amount), cuts[amount], base)
    return df.withColumn("score", day_score.cast("double") / 100 + amount_score.cast("double"))
