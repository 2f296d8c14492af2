"""Wide price files: a date column and one column per asset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.numbers import to_day, to_number
from panelwright.operators.panel import drop_empty_dates
from panelwright.sources.files import file_order


def read_wide_prices(spark: SparkSession, path: str) -> DataFrame:
    """Long (date, symbol, close) rows of a wide CSV.

    The first column holds the date when none is called ``date``. The last row of a repeated
    date wins as a whole; dates without any price and unparseable dates are dropped.
    """
    text = spark.read.option("header", True).csv(path)
    date_column = "date" if "date" in text.columns else text.columns[0]
    assets = [name for name in text.columns if name != date_column]
    rows = text.select(
        to_day(F.col(f"`{date_column}`")).alias("date"),
        *[to_number(F.col(f"`{name}`")).alias(name) for name in assets],
        file_order().alias("ingest_seq"),
    ).where(F.col("date").isNotNull())
    return drop_empty_dates(unpivot_prices(keep_last_wide(rows, assets), assets))


def keep_last_wide(rows: DataFrame, assets: Sequence[str]) -> DataFrame:
    packed = F.struct(*[F.col(f"`{name}`") for name in assets])
    kept = rows.groupBy("date").agg(F.max_by(packed, F.col("ingest_seq")).alias("kept"))
    return kept.select("date", *[F.col(f"kept.`{name}`").alias(name) for name in assets])


def unpivot_prices(wide: DataFrame, assets: Sequence[str], value: str = "close") -> DataFrame:
    return wide.unpivot(["date"], [F.col(f"`{name}`") for name in assets], "symbol", value)


def combine_series(
    series: DataFrame, assets: Mapping[str, str] | DataFrame, key: str = "symbol", value: str = "close"
) -> DataFrame:
    """Long (date, symbol, close) rows of many single-asset series that one scan holds.

    ``assets`` maps the key of a series (its file name, say) to its asset: a mapping, or a table of
    (key, symbol). Series without an asset are left out; two series of one asset are both there. The
    plan is one scan and one join however many series there are. No join by date is needed: the shared
    calendar comes from the rows' own dates.
    """
    if not isinstance(assets, DataFrame):
        assets = series.sparkSession.createDataFrame(list(assets.items()), "key string, symbol string")
    named = assets.select(F.col("key").alias("__key"), F.col("symbol").alias("__symbol"))
    rows = series.select("date", F.col(key).alias("__key"), F.col(value).alias("close"))
    return rows.join(named, "__key").select("date", F.col("__symbol").alias("symbol"), "close")


def pivot_prices(prices: DataFrame, symbols: Sequence[str], value: str = "close") -> DataFrame:
    """Wide table with one column per listed symbol, for export; any other symbol is an error."""
    known = F.when(F.col("symbol").isin(list(symbols)), F.col("symbol")).otherwise(
        F.raise_error(F.concat(F.lit("symbol without a column: "), F.coalesce("symbol", F.lit("NULL"))))
    )
    listed = prices.withColumn("symbol", known)
    return listed.groupBy("date").pivot("symbol", list(symbols)).agg(F.first(value))


def write_wide_prices(
    prices: DataFrame, symbols: Sequence[str], path: str, value: str = "close"
) -> None:
    wide = pivot_prices(prices, symbols, value).orderBy("date")
    wide.write.mode("overwrite").option("header", True).csv(path)
