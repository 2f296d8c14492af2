"""Measures across symbols on one date.

Statistics are aggregated per date and joined back: partial sums are merged before the
shuffle and the joined table has one row per date. A window by date would move every row and
put a whole cross-section into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numbers import ratio


def moments(names: Sequence[str]) -> list[Column]:
    """Aggregates ``<name>_mean`` and ``<name>_std`` (sample deviation, zero as NULL)."""
    return [
        column
        for name in names
        for column in (
            F.avg(name).alias(f"{name}_mean"),
            F.nullif(F.stddev_samp(name), F.lit(0.0)).alias(f"{name}_std"),
        )
    ]


def zscore(name: str) -> Column:
    """Z-score of ``name`` from the columns that ``moments`` produced."""
    return ratio(F.col(name) - F.col(f"{name}_mean"), F.col(f"{name}_std"))


def composite(weights: Sequence[tuple[str, float]]) -> Column:
    """Weighted sum of z-scores; NULL when any of them is NULL."""
    terms = [F.lit(weight) * zscore(name) for name, weight in weights]
    result = terms[0]
    for term in terms[1:]:
        result = result + term
    return result
