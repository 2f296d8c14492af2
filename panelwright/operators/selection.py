"""Choosing names on signal dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(
    history: Column,
    liquidity: Column,
    staleness: Column,
    in_trend: Column,
    is_risk: Column,
    min_history_rows: Column,
    min_median_amount: Column,
    max_stale_days: Column,
) -> Column:
    """All conditions hold; a NULL measure means not eligible."""
    return F.coalesce(
        (history >= min_history_rows)
        & (liquidity >= min_median_amount)
        & (staleness <= max_stale_days)
        & in_trend
        & is_risk,
        F.lit(False),
    )


def _ranked(rows: DataFrame, keys: Sequence[str], score: str) -> Column:
    """Rank by score, best first; equal scores rank by symbol."""
    order = (F.col(score).desc(), F.col("symbol").asc())
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def top_n(
    rows: DataFrame, keys: Sequence[str], limit: int, score: str = "score", rank: str = "rank"
) -> DataFrame:
    """Best ``limit`` rows per key. Tasks cut their groups to the limit before the shuffle."""
    return rows.withColumn(rank, _ranked(rows, keys, score)).where(F.col(rank) <= limit)


def top_n_per_category(
    rows: DataFrame,
    keys: Sequence[str],
    limit: int,
    per_category: int,
    category: str = "asset_class",
    score: str = "score",
    limit_column: str | None = None,
    per_category_column: str | None = None,
) -> DataFrame:
    """Best rows per key with at most ``per_category`` of one category.

    Taking names by score and skipping full categories equals ranking inside each category
    first and ranking the survivors after. The two limits are plain numbers so that both ranks
    are cut before their shuffle; where they differ by key, the ``*_column`` arguments name the
    columns with the exact limits and the numbers are their maxima.
    """
    inside = top_n(rows, [*keys, category], per_category, score, "category_rank")
    if per_category_column:
        inside = inside.where(F.col("category_rank") <= F.col(per_category_column))
    best = top_n(inside, keys, limit, score, "rank")
    if limit_column:
        best = best.where(F.col("rank") <= F.col(limit_column))
    return best.drop("category_rank")


def with_fallback(selected: Column, fallback: Column) -> Column:
    """The picked names, or the single fallback name, or none when there is no fallback."""
    empty = F.coalesce(F.size(selected), F.lit(0)) == 0
    return F.when(~empty, selected).otherwise(F.array_compact(F.array(fallback)))
