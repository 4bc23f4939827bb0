"""Prices, invoices and revenue as Column expressions and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graduated(quantity: Column, tiers: list[tuple[float, float, float, float]]) -> Column:
    """Price by tiers (from, up to, unit price, flat price of a tier that is reached): each unit at the price of its own tier."""
    parts = [F.greatest(F.lit(0.0), F.least(quantity, F.lit(float(hi))) - lo) * unit + F.when(quantity > lo, flat).otherwise(0.0) for lo, hi, unit, flat in tiers]
    return sum(parts[1:], parts[0])


def volume(quantity: Column, tiers: list[tuple[float, float, float]], beyond: float) -> Column:
    """Price by the first tier (up to, unit price, flat price) that takes the whole quantity; above the last only the unit price `beyond`."""
    price = quantity * beyond
    for upto, unit, flat in reversed(sorted(tiers)):
        price = F.when(quantity <= upto, quantity * unit + flat).otherwise(price)
    return price


def discounted(amount: Column, kind: Column, value: Column) -> Column:
    """After a discount: percent, fixed (not below 0) or trial (nothing is due)."""
    return F.when(kind == "percent", amount * (1 - value / 100)).when(kind == "fixed", F.greatest(F.lit(0.0), amount - value)).when(kind == "trial", 0.0).otherwise(amount)


def months(interval: Column) -> Column:
    return F.when(interval == "monthly", 1).when(interval == "quarterly", 3).otherwise(12)


def period_end(start: Column, interval: Column) -> Column:
    """The same day one month, quarter or year later; cut to the month's last day."""
    return F.add_months(start.cast("date"), months(interval))


def prorated(old: Column, new: Column, begin: Column, end: Column, at: Column) -> tuple[Column, Column, Column]:
    """(credit for the unused part of `old`, charge for the rest of `new`, their difference) of a change on day `at` of a period."""
    share = F.date_diff(end, at) / F.greatest(F.lit(1), F.date_diff(end, begin))
    return old * share, new * share, (new - old) * share


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """`df` with each row's percentage of the column's total; the total is one number from one aggregation."""
    total = df.agg(F.sum(value)).first()[0]
    return df.withColumn(name, 100 * F.col(value) / F.lit(float(total)) if total else F.lit(0.0))
