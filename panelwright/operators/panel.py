"""Panel shape: attaching slots, filling empty slots, finding duplicate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.calendar import slot_calendar


def attach_slots(rows: DataFrame, calendar: DataFrame, *columns: str) -> DataFrame:
    """Add ``pos`` and further calendar columns to (symbol, date) rows."""
    return rows.join(calendar.select("date", "pos", *columns), "date")


def drop_empty_dates(prices: DataFrame) -> DataFrame:
    """Remove dates on which no symbol has a price; other empty cells stay."""
    live = slot_calendar(prices.where(F.col("close").isNotNull()))
    return prices.join(live.select("date"), "date", "left_semi")


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Keys that occur more than once; a panel must have none."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(rows: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Raise when a key repeats, else return the rows. Runs one aggregate job."""
    if not duplicate_keys(rows, keys).isEmpty():
        raise ValueError(f"duplicate {', '.join(keys)} rows")
    return rows


def is_repeated() -> Column:
    """Whether the row's (symbol, pos) occurs more than once; shares the windows by symbol."""
    return F.count(F.lit(1)).over(Window.partitionBy("symbol").orderBy("pos").rangeBetween(0, 0)) > 1


def refuse_repeated(measured: DataFrame) -> DataFrame:
    """Raise when a pinned table marks a repeated key in ``repeated``, else drop the mark.

    One scan of one column; a repeated date would enter returns and weights twice.
    """
    first = measured.where("repeated").select("symbol", "date").limit(1).collect()
    if first:
        raise ValueError(f"duplicate symbol, date rows, such as {first[0].symbol} {first[0].date}")
    return measured.drop("repeated")


def densify(
    rows: DataFrame, calendar: DataFrame, values: Sequence[str] = ("close", "amount")
) -> DataFrame:
    """Dense panel: a row for every symbol on every calendar date, NULL where no bar exists.

    Each row fills the empty slots up to the symbol's next row (the first row also those before
    it), so the result is emitted from one pass over rows partitioned by symbol: no product of
    symbols and dates is formed, and later windows by symbol reuse the partitioning. A repeated
    (symbol, date) raises when the result is computed.

    The rotation plans do not need this form. Their windows are framed by slot number over the
    existing rows, which gives the same values because empty slots hold only NULLs.
    """
    last_pos = calendar.select(F.max("pos")).scalar()
    by_symbol = Window.partitionBy("symbol").orderBy("pos")
    spans = attach_slots(rows.select("symbol", "date", *values), calendar).select(
        "symbol",
        "pos",
        *values,
        F.when(F.lag("pos").over(by_symbol).isNull(), F.lit(0))
        .otherwise(F.col("pos"))
        .alias("from_pos"),
        F.when(
            F.lead("pos").over(by_symbol) == F.col("pos"),
            F.raise_error(F.lit("duplicate symbol, date rows")).cast("int"),
        )
        .otherwise(F.coalesce(F.lead("pos").over(by_symbol) - 1, last_pos))
        .alias("to_pos"),
    )
    slots = spans.select(
        "symbol",
        F.explode(F.sequence("from_pos", "to_pos")).alias("slot"),
        "pos",
        *values,
    ).select(
        "symbol",
        F.col("slot").alias("pos"),
        *[F.when(F.col("slot") == F.col("pos"), F.col(v)).alias(v) for v in values],
    )
    return slots.join(calendar.select("pos", "date"), "pos").select(
        "date", "pos", "symbol", *values
    )
