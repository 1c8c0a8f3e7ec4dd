"""Typed parsing of delimited lines with built-in column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Policy = Literal["drop", "fail"]

# What counts as a number in a field. Blanks around an integer or
# a decimal point in it make the field malformed.
INTEGER = r"^[+-]?[0-9]+$"
SPECIAL_DOUBLE = r"^\s*[+-]?(Infinity|NaN)\s*$"


def split_fields(line: Column, separator: str = ",") -> Column:
    """Fields of a line. Trailing empty fields do not count, so `1,2,` has two.

    A plain separator (no pattern) keeps the JVM on its fast path.
    """
    return F.split(F.rtrim(line, F.lit(separator)), separator)


def int_or_null(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("int"))


def double_or_null(text: Column) -> Column:
    value = text.try_cast("double")
    special = F.isnan(value) | (F.abs(value) == float("inf"))
    # Only `NaN` and `Infinity` as such are numbers, or a literal too large for a double.
    named = text.rlike(r"^\s*[+-]?[A-Za-z]") & ~text.rlike(SPECIAL_DOUBLE)
    return F.when(~(special & named), value)


def _strict(text: Column, value: Column, kind: str) -> Column:
    bad = text.isNotNull() & value.isNull()
    error = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast(kind)
    return F.when(bad, error).otherwise(value)


def strict_int(text: Column) -> Column:
    """The integer, or an error that names the malformed text."""
    return _strict(text, int_or_null(text), "int")


def strict_double(text: Column) -> Column:
    return _strict(text, double_or_null(text), "double")


def is_digits(text: Column) -> Column:
    """Whether every character is a digit; true for the empty text."""
    return text.rlike(r"^[0-9]*$")


@dataclass(frozen=True)
class Layout:
    """How one kind of line is laid out and what to do with lines that do not fit.

    `ints` and `doubles` name the fields that are read; the others only count
    towards the number of fields.
    """

    fields: tuple[str, ...]
    ints: tuple[str, ...]
    doubles: tuple[str, ...] = ()
    quoted: tuple[str, ...] = ()
    separator: str = ","
    more_fields: bool = False
    bad_arity: Policy = "drop"
    bad_number: Policy = "drop"
    optional: tuple[str, ...] = ()


_PROFILE = (
    "user_id", "item_id", "login_times", "login_days", "duration", "pay_times", "amount",
    "gender", "theme", "style", "community", "type1", "type2", "channel",
)

PURCHASES = Layout(("user_id", "item_id", "amount"), ("user_id", "item_id"), ("amount",), quoted=("item_id",))
ACTIVITY = Layout(
    ("user_id", "item_id", "login_days", "amount"),
    ("user_id", "item_id", "login_days", "amount"),
    bad_arity="fail",
    bad_number="fail",
)
PURCHASES_WITH_FLAGS = Layout(
    ("user_id", "item_id", "amount", "item_count", "played"),
    ("user_id", "item_id"),
    ("amount",),
    quoted=("item_id",),
    bad_number="fail",
)
ENGAGEMENT = Layout(
    ("user_id", "item_id", "amount", "login_days", "login_times", "item_count"),
    ("user_id", "item_id"),
    ("login_days",),
    bad_number="fail",
)
PROFILE = Layout(_PROFILE, ("user_id", "item_id", "amount"), bad_number="fail")
PROFILE_WITH_TOTALS = Layout(
    (*_PROFILE, "item_count", "total_amount"), ("user_id", "item_id", "amount"), bad_number="fail"
)
PROFILE_WITH_RATE = Layout((*_PROFILE, "login_rate"), ("user_id", "item_id", "login_days"), ("login_rate",))
GRADES = Layout(("user_id", "item_id", "grade", "amount"), ("user_id", "item_id"), ("grade",), bad_number="fail")
GRADES_WITH_FLAGS = Layout(
    ("user_id", "item_id", "grade", "amount", "item_count", "played"),
    ("user_id", "item_id"),
    ("grade",),
    bad_number="fail",
)
USER_LIST = Layout(("user_id",), ("user_id",), more_fields=True)
AMOUNTS = Layout(
    ("user_id", "item_id", "skipped", "amount"),
    ("user_id", "item_id"),
    ("amount",),
    quoted=("item_id",),
    bad_number="fail",
    optional=("amount",),
)
COUNTS = Layout(
    ("user_id", "item_id", "count"),
    ("user_id", "item_id", "count"),
    separator=" ",
    bad_arity="fail",
    bad_number="fail",
)


def parse(lines: DataFrame, layout: Layout, line: str = "value") -> DataFrame:
    """Read the layout's numeric fields of every line.

    A line with the wrong number of fields or a malformed number is dropped or
    raises, as the layout says; a malformed `optional` field always drops the line.
    """
    fields = split_fields(F.col(line), layout.separator)
    wanted = len(layout.fields)
    # Generated rows keep the optimizer from repeating the split per column, and the
    # conversions in the filter below.
    rows = lines.select(F.explode(F.array(fields)).alias("_fields"))
    fits = F.size("_fields") >= wanted if layout.more_fields else F.size("_fields") == wanted
    if layout.bad_arity == "fail":
        shape = F.raise_error(
            F.concat(F.lit(f"expected {wanted} fields: "), F.array_join("_fields", layout.separator))
        ).cast("boolean")
        fits = F.when(fits, F.lit(True)).otherwise(shape)
    rows = rows.where(fits)

    columns = []
    for name in (*layout.ints, *layout.doubles):
        text = F.get("_fields", layout.fields.index(name))
        if name in layout.quoted:
            text = F.replace(text, F.lit('"'), F.lit(""))
        strict = layout.bad_number == "fail" and name not in layout.optional
        if name in layout.ints:
            value = strict_int(text) if strict else int_or_null(text)
        else:
            value = strict_double(text) if strict else double_or_null(text)
        columns.append(value.alias(name))
    complete = F.lit(True)
    for name in (*layout.ints, *layout.doubles):
        complete = complete & F.col(name).isNotNull()
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("_row")).select("_row.*").where(complete)


def parse_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """`id<TAB>name` lines; lines without a tab or with a non-numeric id are dropped, names are trimmed."""
    text = F.col(line)
    tab = F.instr(text, "\t")
    name = F.regexp_replace(F.substring(text, tab, F.length(text)), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    rows = lines.where(tab > 0).select(
        int_or_null(F.substring_index(text, "\t", 1)).alias("item_id"),
        name.alias("name"),
    )
    return rows.dropna(subset=["item_id"])


def parse_aliases(lines: DataFrame, line: str = "value") -> DataFrame:
    """`bad_id<TAB>good_id` lines; an empty first field drops the line, other malformed ones raise."""
    fields = F.split(F.col(line), "\t")
    rows = lines.select(F.explode(F.array(fields)).alias("_fields")).select(
        F.get("_fields", F.lit(0)).alias("_bad"), F.get("_fields", F.lit(1)).alias("_good")
    )
    rows = rows.where(F.col("_bad") != "")
    good = F.when(F.col("_good").isNull(), F.raise_error(F.lit("alias without a target")).cast("int"))
    return rows.select(
        strict_int(F.col("_bad")).alias("bad_id"),
        good.otherwise(strict_int(F.col("_good"))).alias("good_id"),
    )


def parse_counts(lines: DataFrame, line: str = "value", separator: str = ",") -> DataFrame:
    """Lines of numbers as an `array<double>` column; a malformed number raises."""
    numbers = F.transform(split_fields(F.col(line), separator), strict_double)
    return lines.withColumn("counts", numbers).drop(line)
