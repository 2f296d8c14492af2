"""Explicit schemas of the tables the library reads and produces."""

from __future__ import annotations

# Columns of the stored tables, as other tools read them.
PRICE_FIELDS = ("open", "high", "low", "close", "volume", "amount")

CATALOG = "symbol string, name string"
ADJUSTED = (
    "symbol string, date date, close double, total_return_proxy double, "
    "cumulative_dividend double, split_factor double"
)
QUALITY = (
    "symbol string, name string, asset_class string, rows_raw long, rows_valid long, "
    "duplicate_dates long, null_close long, non_positive_close long, first_date date, "
    "last_date date, span_days int, median_amount_60d double, zero_volume_ratio_60d double"
)
FETCH_RESULTS = "symbol string, name string, rows long, source string, status string, error string"


def column_names(ddl: str) -> list[str]:
    """Column names of one of the DDL strings above, in order."""
    return [field.split()[0] for field in ddl.split(",")]
