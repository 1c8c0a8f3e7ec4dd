"""Rules that turn raw amounts and activity into ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also where it is unknown)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def paid(amount: Column) -> Column:
    """Whether any money was spent. NaN, which Spark sorts above every number, is not money."""
    return flag((amount > 0) & ~F.isnan(amount.cast("double")))


def active_at_least(days: Column, least: float) -> Column:
    return flag((days >= least) & ~F.isnan(days.cast("double")))


def active_more_than(days: Column, bound: float) -> Column:
    return flag((days > bound) & ~F.isnan(days.cast("double")))


def active_or_frequent(days: Column, rate: Column, bound: float = 1) -> Column:
    """More than `bound` login days or a login rate above `bound`."""
    return flag(((days > bound) & ~F.isnan(days.cast("double"))) | ((rate > bound) & ~F.isnan(rate.cast("double"))))


def payer_class(amount: Column) -> Column:
    """1 for payers and 2 for the rest; NaN is not money."""
    return F.when((amount > 0) & ~F.isnan(amount.cast("double")), F.lit(1)).otherwise(F.lit(2))


def engaged(login_days: Column, login_times: Column) -> Column:
    """At least one login day and two logins; text that is no number does not count."""
    return (login_days.try_cast("int") >= 1) & (login_times.try_cast("int") >= 2)
