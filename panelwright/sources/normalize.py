"""Map vendor tables with English or Chinese headers onto the canonical columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import schemas
from panelwright.functions.numbers import finite, to_day, to_number
from panelwright.functions.text import padded_symbol

# Accepted source headers per canonical column, in order of preference.
BAR_ALIASES: Mapping[str, Sequence[str]] = {
    "date": ("date", "日期", "交易日期"),
    "open": ("open", "开盘"),
    "high": ("high", "最高"),
    "low": ("low", "最低"),
    "close": ("close", "收盘"),
    "volume": ("volume", "成交量"),
    "amount": ("amount", "成交额"),
}
SERIES_ALIASES: Mapping[str, Sequence[str]] = {
    "date": ("date", "日期", "交易日期", "净值日期"),
    "close": ("close", "收盘", "单位净值", "复权单位净值"),
}
CATALOG_ALIASES: Mapping[str, Sequence[str]] = {
    "symbol": ("代码", "code"),
    "name": ("名称", "name"),
}


def resolve(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Canonical name to the first alias present in ``columns``; absent ones are left out."""
    found = {
        target: next((name for name in names if name in columns), None)
        for target, names in aliases.items()
    }
    return {target: source for target, source in found.items() if source is not None}


def _coerced(frame: DataFrame, source: str, is_date: bool):
    kind = dict(frame.dtypes)[source]
    column = F.col(f"`{source}`")
    if is_date:
        return to_day(column) if kind == "string" else column.cast("date")
    return to_number(column) if kind == "string" else finite(column.cast("double"))


def normalize_bars(
    frame: DataFrame, symbol: str, order: str, by: Sequence[str] = ()
) -> DataFrame:
    """Canonical OHLCV rows, the first row of each date kept; absent columns are typed NULL.

    ``order`` names the column that gives the row order, such as ``files.file_order`` taken at the
    scan; ``by`` names further key columns, for a table that holds many symbols.
    """
    found = resolve(frame.columns, BAR_ALIASES)
    if "date" not in found or "close" not in found:
        raise ValueError(f"no date or close column for {symbol} in {frame.columns}")
    fields = [
        (
            _coerced(frame, found[name], False)
            if name in found
            else F.lit(None).cast("double")
        ).alias(name)
        for name in schemas.PRICE_FIELDS
    ]
    rows = frame.select(
        *by, _coerced(frame, found["date"], True).alias("date"), *fields, F.col(order).alias("row_order")
    ).where(F.col("date").isNotNull() & F.col("close").isNotNull())
    return keep_first(rows, [*by, "date"], schemas.PRICE_FIELDS, "row_order")


def normalize_series(
    frame: DataFrame, order: str, name: str = "close", by: Sequence[str] = ()
) -> DataFrame:
    """(date, value) rows without nulls, the first row of each date by ``order`` kept."""
    found = resolve(frame.columns, SERIES_ALIASES)
    if len(found) < 2:
        raise ValueError(f"no {name} data columns in {frame.columns}")
    rows = frame.select(
        *by,
        _coerced(frame, found["date"], True).alias("date"),
        _coerced(frame, found["close"], False).alias(name),
        F.col(order).alias("row_order"),
    ).na.drop(subset=["date", name])
    return keep_first(rows, [*by, "date"], [name], "row_order")


def keep_first(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str
) -> DataFrame:
    """First row per key. An aggregate, so copies of a key are merged before the shuffle."""
    kept = [F.min_by(value, order).alias(value) for value in values]
    return rows.groupBy(*keys).agg(*kept)


def normalize_catalog(frame: DataFrame, order: str) -> DataFrame:
    """Symbol list of a vendor quote table: padded codes, the first row per symbol by ``order``."""
    found = resolve(frame.columns, CATALOG_ALIASES)
    if len(found) < 2:
        raise ValueError(f"no code or name column in {frame.columns}")
    rows = frame.select(
        padded_symbol(F.col(f"`{found['symbol']}`")).alias("symbol"),
        F.col(f"`{found['name']}`").alias("name"),
        F.col(order).alias("row_order"),
    )
    return keep_first(rows, ["symbol"], ["name"], "row_order")


def date_slice(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= date <= end; either bound may be left out."""
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars
