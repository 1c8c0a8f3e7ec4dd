"""Exact order statistics and ranks without sorting a column in one task."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propense.limits import EXACT_ROWS, PART_ROWS, RANGES, SKETCH_ACCURACY
from propense.operators.joins import lookup_join
from propense.sources.staging import stage


def order_statistics(
    df: DataFrame, column: str, ranks: list[int], exact_rows: int = EXACT_ROWS, accuracy: int = SKETCH_ACCURACY
) -> list[float]:
    """The exact `rank`-th smallest non-null, non-NaN values of a column (ranks start at 1)."""
    return select_ranks(df, {column: ranks}, exact_rows, accuracy)[column]


@dataclass(frozen=True)
class _Bracket:
    """An open interval of a column known to hold a wanted value, as its `rank`-th of `rows`."""

    column: str
    low: float | None
    high: float | None
    rank: int
    rows: int

    def holds(self) -> Column:
        value = F.col(self.column)
        condition = value.isNotNull()
        if self.low is not None:
            condition = condition & (value > F.lit(self.low))
        if self.high is not None:
            condition = condition & (value < F.lit(self.high))
        return condition


def _values(df: DataFrame, column: str) -> Column:
    """A column's values, null where they are null or NaN."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(value), value)
    return value


def count_values(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Number of each column's values, without nulls and NaN."""
    counts = df.agg(*[F.count(_values(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, counts, strict=True))


def select_long(df: DataFrame, column: str, rank: int) -> int:
    """The exact `rank`-th smallest value of a column of whole numbers of up to 64 bits.

    Doubles hold no more than 53 bits, so the upper and lower halves are
    selected one after the other.
    """
    value = F.col(column).cast("long")
    halves = df.where(F.col(column).isNotNull()).select(
        F.shiftright(value, 32).alias("upper"), value.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lower")
    )
    upper = int(order_statistics(halves, "upper", [rank])[0])
    below = halves.where(F.col("upper") < upper).count()
    lower = int(order_statistics(halves.where(F.col("upper") == upper), "lower", [rank - below])[0])
    return (upper << 32) + lower


def select_ranks(
    df: DataFrame,
    ranks: dict[str, list[int]],
    exact_rows: int = EXACT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
    totals: dict[str, int] | None = None,
) -> dict[str, list[float]]:
    """Exact order statistics of several columns in common passes, in double precision.

    Whole numbers beyond 2**53 need `select_long`. `totals` spares counting the
    columns' values where that has been done.

    Every pass brackets each wanted rank between two values from a quantile
    sketch and counts what lies below, so that the next pass only looks at the
    open interval between them: about `6 / accuracy` of the rows, however many
    copies of one value there are. A rank is read off exactly once its interval
    holds at most `exact_rows` rows. Only the bracket ends and counts come to
    the driver.
    """
    names = {column: f"v{i}" for i, column in enumerate(ranks)}
    numbers = {name: F.col(column).cast("double") for column, name in names.items()}
    values = df.select(*[F.when(~F.isnan(value), value).alias(name) for name, value in numbers.items()])
    totals = totals or count_values(df, list(ranks))
    pending: dict[tuple[str, int], _Bracket] = {}
    for column, wanted in ranks.items():
        total = totals[column]
        for rank in sorted(set(wanted)):
            if not 1 <= rank <= total:
                raise ValueError(f"rank {rank} of {total} values")
            pending[column, rank] = _Bracket(names[column], None, None, rank, total)
    found: dict[tuple[str, int], float] = {}
    while pending:
        found |= _read_off(values, {k: b for k, b in pending.items() if b.rows <= exact_rows})
        now, pending = _narrow(values, {k: b for k, b in pending.items() if b.rows > exact_rows}, accuracy)
        found |= now
    return {column: [found[column, rank] for rank in wanted] for column, wanted in ranks.items()}


def _read_off(values: DataFrame, brackets: dict) -> dict:
    """Ranks whose intervals are small enough to be sorted, one task per interval."""
    if not brackets:
        return {}
    intervals = {(b.column, b.low, b.high): b for b in brackets.values()}
    numbers = {interval: i for i, interval in enumerate(intervals)}
    hits = [
        F.when(b.holds(), F.struct(F.lit(i).alias("interval"), F.col(b.column).alias("v")))
        for i, b in enumerate(intervals.values())
    ]
    anywhere = functools.reduce(lambda x, y: x | y, [b.holds() for b in intervals.values()])
    rows = values.where(anywhere).select(F.inline(F.array_compact(F.array(*hits))))
    reached = F.sum("count").over(Window.partitionBy("interval").orderBy("v"))
    counts = rows.groupBy("interval", "v").count().withColumn("reached", reached)
    picks = []
    for b in brackets.values():
        here = (F.col("interval") == numbers[b.column, b.low, b.high]) & (F.col("reached") >= b.rank)
        picks.append(F.min(F.when(here, F.col("v"))))
    return dict(zip(brackets, counts.agg(*picks).first(), strict=True))


def _narrow(values: DataFrame, brackets: dict, accuracy: int) -> tuple[dict, dict]:
    """One narrowing pass: bracket every rank more closely, then count around the new ends."""
    if not brackets:
        return {}, {}
    slack = 2 / accuracy
    shares: dict[tuple, list[float]] = {}
    for b in brackets.values():
        share = (b.rank - 0.5) / b.rows
        ends = [max(0.0, share - slack), min(1.0, share + slack)]
        shares.setdefault((b.column, b.low, b.high), []).extend(ends)
    owners = {(b.column, b.low, b.high): b for b in brackets.values()}
    sketches = [
        F.percentile_approx(F.when(owners[i].holds(), F.col(owners[i].column)), wanted, accuracy)
        for i, wanted in shares.items()
    ]
    found_ends = {i: iter(ends) for i, ends in zip(shares, values.agg(*sketches).first(), strict=True)}
    ends = {key: [next(found_ends[b.column, b.low, b.high]) for _ in range(2)] for key, b in brackets.items()}

    marks: dict[str, set[float]] = {}
    for key, b in brackets.items():
        known = {e for e in (b.low, b.high) if e is not None}
        marks.setdefault(b.column, set()).update(ends[key], known)
    tallies = {column: _Tally(sorted(points)) for column, points in marks.items()}
    places = [
        F.when(F.col(column).isNotNull(), F.struct(F.lit(i).alias("of"), place(F.col(column), tally.points).alias("at")))
        for i, (column, tally) in enumerate(tallies.items())
    ]
    counted = values.select(F.inline(F.array_compact(F.array(*places)))).groupBy("of", "at").count().collect()
    for row in counted:
        list(tallies.values())[row["of"]].counts[row["at"]] = row["count"]

    found, left = {}, {}
    for key, b in brackets.items():
        lower, upper = ends[key]
        tally = tallies[b.column]
        below = tally.between(b.low, lower)
        at_lower, between = tally.at(lower), tally.between(lower, upper)
        at_upper = tally.at(upper) if lower < upper else 0
        rest = b.rank - below
        if rest <= 0:
            left[key] = replace(b, high=lower, rows=below)
        elif rest <= at_lower:
            found[key] = lower
        elif rest <= at_lower + between:
            left[key] = replace(b, low=lower, high=upper, rank=rest - at_lower, rows=between)
        elif rest <= at_lower + between + at_upper:
            found[key] = upper
        else:
            passed = below + at_lower + between + at_upper
            left[key] = replace(b, low=upper, rank=b.rank - passed, rows=b.rows - passed)
    return found, left


def place(value: Column, points: list[float]) -> Column:
    """Where a value lies among ascending points: 2 i + 1 at point i, 2 i in the gap before it."""

    def search(first: int, last: int) -> Column:
        if first == last:
            return F.lit(2 * first)
        middle = (first + last) // 2
        point = F.lit(points[middle])
        return (
            F.when(value < point, search(first, middle))
            .when(value == point, F.lit(2 * middle + 1))
            .otherwise(search(middle + 1, last))
        )

    return search(0, len(points))


class _Tally:
    """Rows counted by their place among points."""

    def __init__(self, points: list[float]):
        self.points = points
        self.counts: dict[int, int] = {}

    def at(self, point: float) -> int:
        return self.counts.get(2 * self.points.index(point) + 1, 0)

    def between(self, low: float | None, high: float) -> int:
        """Rows strictly between two points, or below the second."""
        first = -1 if low is None else 2 * self.points.index(low) + 1
        last = 2 * self.points.index(high) + 1
        return sum(n for at, n in self.counts.items() if first < at < last)


def range_splits(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Ends of about equally filled ranges of a column, for a `Bucketizer`."""
    shares = [i / ranges for i in range(1, ranges)]
    value = F.col(column).cast("double")
    ends = df.agg(F.percentile_approx(value, shares, ranges * 10)).first()[0] or []
    inner = sorted({e for e in ends if math.isfinite(e)}) or [0.0]
    return [-math.inf, *inner, math.inf]


def with_range(df: DataFrame, column: str, splits: list[float], name: str = "_range") -> DataFrame:
    """Add the number of the range a value falls in; equal values share a range."""
    numbered = df.withColumn("_as_double", F.col(column).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="_as_double", outputCol=name)
    return bucketizer.transform(numbered).drop("_as_double")


def dense_index(ids: DataFrame, column: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Number distinct ids 0, 1, 2, ... in ascending order, as 64-bit numbers.

    The ids are dealt into as many ranges as their number asks for and sorted
    within each; a row's number is its place there behind the sizes of the ranges before.
    """
    ids = stage(ids.select(column), "distinct")
    parts = max(1, math.ceil(ids.count() / part_rows))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ids.repartitionByRange(parts, column).sortWithinPartitions(column)
    placed = stage(ranged.select(column, F.spark_partition_id().alias("_part"), place.alias("_place")), "placed")
    offsets = stage(running_offsets(placed.groupBy("_part").agg(F.count("*").alias("_size"))), "offsets")
    return lookup_join(placed, offsets, "_part", "inner").select(column, (F.col("_place") + F.col("_offset")).alias(name))


def running_offsets(sizes: DataFrame, block: int = PART_ROWS) -> DataFrame:
    """`_part, _offset`: the sum of `_size` over all smaller parts, added up in blocks of parts and then over the blocks."""
    blocked = sizes.withColumn("_block", F.expr(f"_part div {block}"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("_block").agg(F.sum("_size").alias("_total"))
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(starts, "_block")
        .select("_part", (F.col("_start") + F.col("_within")).alias("_offset"))
    )
