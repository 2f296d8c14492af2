"""Symbol helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_symbol(symbol: Column) -> Column:
    """Left-pad to six characters with zeros; longer symbols stay whole."""
    text = symbol.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def market_prefix(symbol: Column) -> Column:
    """Exchange prefix of a listed fund code."""
    return F.when(F.substring(symbol, 1, 2).isin("15", "16"), F.lit("sz")).otherwise(F.lit("sh"))


def general_number(value: float) -> str:
    """Six-significant-digit text of a threshold, as shown in exclusion reasons."""
    return f"{value:g}"
