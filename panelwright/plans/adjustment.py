"""Total-return prices from dividend and split factors."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import schemas
from panelwright.operators.asof import asof_backward
from panelwright.operators.panel import require_unique
from panelwright.scratch import pin
from panelwright.sources import files, sinks


class Adjustment(NamedTuple):
    adjusted: DataFrame
    missing: DataFrame


def adjusted_prices(bars: DataFrame, factors: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """close * split factor + cumulative dividend, from the latest factor row of each bar.

    Missing factors are 1 and 0. Of several factor rows on one date the last by ``ingest_seq``
    counts, where the factors have it. ``carry`` names further bar columns to keep; carrying
    ``amount`` saves the research job a join.
    """
    bars = bars.select("symbol", "date", "close", *carry)
    order = "ingest_seq" if "ingest_seq" in factors.columns else None
    joined = asof_backward(bars, factors, "symbol", "date", ["s", "u"], order=order)
    split = F.coalesce("s", F.lit(1.0))
    dividend = F.coalesce("u", F.lit(0.0))
    return joined.select(
        "symbol",
        "date",
        "close",
        (F.col("close") * split + dividend).alias("total_return_proxy"),
        dividend.alias("cumulative_dividend"),
        split.alias("split_factor"),
        *carry,
    )


def build_total_return(
    bars: DataFrame,
    factors: DataFrame,
    factor_inventory: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> Adjustment:
    """Adjusted bars of the symbols that have a factor source, and the symbols that have none.

    The inventory also lists symbols whose factor source is empty; their prices stay as they are.
    """
    source = factors if factor_inventory is None else factor_inventory
    covered = source.select("symbol").distinct()
    kept = bars.join(covered, "symbol", "left_semi")
    missing = bars.select("symbol").distinct().join(covered, "symbol", "left_anti")
    return Adjustment(adjusted_prices(kept, factors, carry), missing)


def adjustment_totals(bars: DataFrame, result: Adjustment) -> DataFrame:
    """One row: symbols adjusted and symbols skipped."""
    symbols = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("symbols"))
    failed = result.missing.select(F.count(F.lit(1))).scalar()
    return symbols.withColumn("failed", failed).select(
        (F.col("symbols") - F.col("failed")).alias("success"), "failed"
    )


ADJUSTED_COLUMNS = schemas.column_names(schemas.ADJUSTED)


def build_total_return_from_files(
    spark: SparkSession, bars_path: str, factors_path: str, output: str
) -> Adjustment:
    """From stored bars and a folder of factor files to the stored adjusted table.

    The table (by year) is what ``scan_research`` reads; it keeps the amount, which saves the
    research job a join. Symbols without a factor file go to a report, the counts to a summary.
    (symbol, date) is the table's key: bars that repeat one are refused before anything is written.
    """
    bars = require_unique(spark.read.parquet(bars_path))
    factors = files.read_factor_files(spark, factors_path)
    inventory = files.file_inventory(spark, factors_path)
    result = build_total_return(bars, factors, inventory, ["amount"])
    sinks.write_by_year(result.adjusted.select(*ADJUSTED_COLUMNS, "amount"), f"{output}/adjusted")
    missing = pin(result.missing, "missing")
    sinks.write_report(missing, f"{output}/missing_factors", "symbol")
    stored = Adjustment(spark.read.parquet(f"{output}/adjusted").drop("year"), missing)
    adjustment_totals(bars, stored).write.mode("overwrite").json(f"{output}/adjustment_totals")
    return stored
