"""Scans of the stored tables; Catalyst pushes the filters and columns into parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.sources.normalize import date_slice

RAW = "raw"
TOTAL_RETURN = "total-return"


def restrict(
    rows: DataFrame,
    symbols: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Optional symbol set (a list or a table with a ``symbol`` column) and date range."""
    rows = date_slice(rows, start, end)
    if symbols is None:
        return rows
    if isinstance(symbols, DataFrame):
        return rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return rows.where(F.col("symbol").isin(list(symbols))) if symbols else rows


def scan_prices(
    bars: DataFrame,
    symbols: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Close prices only, in long form."""
    return restrict(bars.select("symbol", "date", "close"), symbols, start, end)


def scan_research(
    bars: DataFrame,
    adjusted: DataFrame | None = None,
    price_mode: str = RAW,
    symbols: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """(symbol, date, close, amount) rows for one price mode.

    In total-return mode the price is the adjusted one. The traded amount comes with the
    adjusted table when it was carried along there, else from the bars by (symbol, date).
    """
    if price_mode not in (RAW, TOTAL_RETURN):
        raise ValueError(f"unknown price mode {price_mode!r}")
    raw = restrict(bars.select("symbol", "date", "close", "amount"), symbols, start, end)
    if price_mode == RAW:
        return raw
    if adjusted is None:
        raise ValueError("total-return mode needs the adjusted table")
    carried = "amount" in adjusted.columns
    columns = ["symbol", "date", F.col("total_return_proxy").alias("close")]
    rows = restrict(
        adjusted.select(*columns, *(["amount"] if carried else [])), symbols, start, end
    )
    if carried:
        return rows
    return align_amount(rows, raw)


def align_amount(prices: DataFrame, bars: DataFrame) -> DataFrame:
    """Give each price row the amount of the same symbol and date, NULL where there is none."""
    return prices.join(bars.select("symbol", "date", "amount"), ["symbol", "date"], "left")
