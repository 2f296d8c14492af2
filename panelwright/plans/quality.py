"""Bars and quality tables, universe snapshot and research universe."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.classify import CASH, DEFAULT_CLASS, DEFAULT_RULES, Rules
from panelwright.functions.text import general_number
from panelwright.operators import cleaning
from panelwright.operators.ranks import exact_quantiles
from panelwright.operators.selection import top_n
from panelwright.scratch import pin
from panelwright.sources import files, sinks

# Default rules of the snapshot and the research pool.
MIN_HISTORY_ROWS = 252
MAX_STALE_DAYS = 30
MIN_MEDIAN_AMOUNT = 10_000_000.0


class BarsBuild(NamedTuple):
    bars: DataFrame
    quality: DataFrame


def build_bars(
    raw: DataFrame,
    catalog: DataFrame,
    inventory: DataFrame | None = None,
    rules: Rules = DEFAULT_RULES,
    default_class: str = DEFAULT_CLASS,
) -> BarsBuild:
    """Clean bars and their quality table; the raw rows are read once."""
    groups = pin(cleaning.daily_groups(raw), "daily-groups")
    stats = cleaning.audit(groups, inventory)
    quality = cleaning.name_and_class(stats, catalog, rules, default_class)
    return BarsBuild(cleaning.cleaned(groups), quality)


def build_bars_from_files(
    spark: SparkSession, bars_path: str, catalog_path: str, output: str
) -> BarsBuild:
    """Read a folder of bar files and store the bars (by year), quality table and summary."""
    built = build_bars(
        files.read_bar_files(spark, bars_path),
        files.read_catalog(spark, catalog_path),
        files.file_inventory(spark, bars_path),
    )
    sinks.write_by_year(built.bars, f"{output}/bars")
    sinks.write_table(built.quality, f"{output}/quality")
    quality = files.read_quality(spark, f"{output}/quality")
    sinks.write_report(quality, f"{output}/quality_report", "symbol")
    summary = quality_summary(quality, files.read_catalog(spark, catalog_path))
    summary.write.mode("overwrite").json(f"{output}/quality_summary")
    return BarsBuild(spark.read.parquet(f"{output}/bars").drop("year"), quality)


def counts_by_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("asset_class").agg(F.count(F.lit(1)).alias("symbols"))


def _class_map(rows: DataFrame):
    """Scalar subquery: map of class to count, one entry per class."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset_class", "symbols"))))
    return counts_by_class(rows).agg(entries).scalar()


def quality_summary(quality: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of totals over the quality table, with counts by class as a map.

    The quantiles are exact and computed at once; give a stored quality table.
    """
    [rows] = exact_quantiles(quality, "rows_valid", [0.5])
    quartiles = exact_quantiles(quality, "median_amount_60d", [0.25, 0.5, 0.75])
    return quality.agg(
        F.count(F.lit(1)).alias("history_count"),
        F.count_if(F.col("rows_valid") > 0).alias("valid_count"),
        F.sum("rows_valid").alias("total_daily_rows"),
    ).select(
        catalog.select(F.count(F.lit(1))).scalar().alias("catalog_count"),
        "history_count",
        "valid_count",
        "total_daily_rows",
        F.lit(rows).cast("double").alias("median_history_rows"),
        *[
            F.lit(value).cast("double").alias(name)
            for name, value in zip(("amount_q25", "amount_q50", "amount_q75"), quartiles, strict=True)
        ],
        _class_map(quality).alias("asset_class_counts"),
    )


def with_stale_days(quality: DataFrame) -> DataFrame:
    """Days between the newest last date of all symbols and each symbol's own."""
    as_of = quality.select(F.max("last_date")).scalar()
    return quality.withColumn("as_of", as_of).withColumn(
        "stale_days", F.datediff("as_of", "last_date")
    )


def universe_snapshot(
    quality: DataFrame,
    min_history_rows: int = MIN_HISTORY_ROWS,
    max_stale_days: int = MAX_STALE_DAYS,
    min_median_amount: float = MIN_MEDIAN_AMOUNT,
    excluded_classes: Sequence[str] = (CASH,),
) -> DataFrame:
    """Quality rows with ``stale_days``, ``eligible`` and ``reasons`` in a fixed order.

    A comparison with NULL is no reason to exclude.
    """
    checks = [
        (F.col("rows_valid") < min_history_rows, f"history<{min_history_rows}"),
        (F.col("stale_days") > max_stale_days, f"stale>{max_stale_days}d"),
        (
            F.col("median_amount_60d") < min_median_amount,
            f"amount<{general_number(min_median_amount)}",
        ),
        (F.col("asset_class").isin(list(excluded_classes)), "excluded_asset_class"),
    ]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in checks]))
    return (
        with_stale_days(quality)
        .withColumn("reasons", reasons)
        .withColumn("eligible", F.size("reasons") == 0)
    )


def export_snapshot(snapshot: DataFrame) -> DataFrame:
    """Snapshot with reasons as text, in report order."""
    flat = snapshot.withColumn("exclusion_reason", F.array_join("reasons", ";")).drop(
        "reasons", "as_of"
    )
    return flat.orderBy(
        F.col("eligible").desc(),
        F.col("asset_class").asc(),
        F.col("median_amount_60d").desc(),
        F.col("symbol").asc(),
    )


def snapshot_totals(snapshot: DataFrame) -> DataFrame:
    """One row: date, total, eligible and excluded symbols, eligible ones by class."""
    return snapshot.agg(
        F.max("as_of").alias("as_of"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(~F.col("eligible")).alias("excluded"),
    ).withColumn("eligible_by_asset_class", _class_map(snapshot.where("eligible")))


def build_snapshot(
    spark: SparkSession, quality_path: str, output: str, **rules
) -> tuple[DataFrame, DataFrame]:
    """From the stored quality table to the snapshot's report (CSV) and totals (JSON)."""
    snapshot = pin(universe_snapshot(files.read_quality(spark, quality_path), **rules), "snapshot")
    sinks.write_ordered_report(export_snapshot(snapshot), f"{output}/snapshot")
    totals = snapshot_totals(snapshot)
    totals.write.mode("overwrite").json(f"{output}/snapshot_totals")
    return snapshot, totals


# The columns of the research pool's report.
RESEARCH_COLUMNS = (
    "symbol",
    "name",
    "asset_class",
    "rows_valid",
    "first_date",
    "last_date",
    "median_amount_60d",
)


def research_universe(
    quality: DataFrame,
    per_category: int = 50,
    cash_count: int = 5,
    min_history_rows: int = MIN_HISTORY_ROWS,
    max_stale_days: int = MAX_STALE_DAYS,
    min_median_amount: float = MIN_MEDIAN_AMOUNT,
) -> DataFrame:
    """The most liquid symbols of every risk class plus a few of cash, NULLs excluded."""
    base = with_stale_days(quality).where(
        (F.col("rows_valid") >= min_history_rows)
        & (F.col("stale_days") <= max_stale_days)
        & (F.col("median_amount_60d") >= min_median_amount)
    )
    is_cash = F.col("asset_class") == CASH
    risk = top_n(base.where(~is_cash), ["asset_class"], per_category, "median_amount_60d")
    cash = top_n(base.where(is_cash), ["asset_class"], cash_count, "median_amount_60d")
    return risk.unionByName(cash).select(*RESEARCH_COLUMNS)


def export_research_universe(universe: DataFrame) -> DataFrame:
    return universe.orderBy(
        F.col("asset_class").asc(), F.col("median_amount_60d").desc(), F.col("symbol").asc()
    )


def research_totals(quality: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: newest date of the quality table, symbols chosen, and chosen ones by class."""
    return quality.agg(F.max("last_date").alias("as_of")).select(
        "as_of",
        universe.select(F.count(F.lit(1))).scalar().alias("selected"),
        _class_map(universe).alias("selected_by_asset_class"),
    )


def build_research_universe(
    spark: SparkSession, quality_path: str, output: str, **rules
) -> tuple[DataFrame, DataFrame]:
    """From the stored quality table to the research pool's report (CSV) and totals (JSON)."""
    quality = files.read_quality(spark, quality_path)
    universe = pin(research_universe(quality, **rules), "pool")
    sinks.write_ordered_report(export_research_universe(universe), f"{output}/research_universe")
    totals = research_totals(quality, universe)
    totals.write.mode("overwrite").json(f"{output}/research_totals")
    return universe, totals
