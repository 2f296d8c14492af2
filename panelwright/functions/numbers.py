"""Numeric and date coercion that turns bad input into NULL instead of failing under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def finite(value: Column) -> Column:
    """NaN and infinities become NULL: Spark orders NaN above every number."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def to_number(text: Column) -> Column:
    """String to double; unparseable text is NULL.

    The JVM parser also takes a type suffix such as ``1d``, which is not a number here.
    """
    suffix = F.lower(F.right(F.trim(text), F.lit(1)))
    return F.when(~suffix.isin("d", "f"), finite(text.try_cast("double")))


def to_day(text: Column) -> Column:
    """String to date for ISO, compact and slashed notations; unparseable text is NULL.

    The JVM's own cast also takes bare numbers as years, such as ``45000``, so it is asked only for
    text that begins with four digits and a dash.
    """
    return F.coalesce(
        F.when(text.rlike(r"^\s*\d{4}-"), text.try_cast("date")),
        F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"),
        F.try_to_timestamp(text, F.lit("yyyy/M/d")).cast("date"),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where a zero denominator gives NULL."""
    return F.try_divide(numerator, denominator)


def annualised(volatility: Column) -> Column:
    return volatility * F.sqrt(F.lit(float(TRADING_DAYS)))


def clip_unit(value: Column) -> Column:
    """Clip to [0, 1], keeping NULL as NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
