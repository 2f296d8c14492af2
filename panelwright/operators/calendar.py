"""The shared calendar: one slot per date that occurs in a table.

The only table-wide ordering in the library happens here, on distinct dates. Their number is
bounded by the days in the covered period (a century has 36,525), whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.dates import week_ending_friday


def slot_calendar(rows: DataFrame) -> DataFrame:
    """Distinct dates of ``rows`` with their slot number and weekly rebalance marks.

    date, pos, week_end, prev_date, next_date;
    is_rebalance: the last available date of a Saturday-to-Friday week;
    active_signal_pos / active_signal_date: the last rebalance slot strictly before this one,
    which is the slot before the first slot of the same week.
    """
    days = rows.where(F.col("date").isNotNull()).select("date").distinct()
    # One row with all days; Catalyst sees the size of a global aggregate and broadcasts joins.
    ordered = days.agg(F.array_sort(F.collect_list("date")).alias("days"))
    slots = ordered.select(
        F.inline(
            F.transform(
                "days",
                lambda day, i: F.struct(
                    day.alias("date"),
                    i.cast("int").alias("pos"),
                    F.get("days", i - 1).alias("prev_date"),
                    F.get("days", i + 1).alias("next_date"),
                ),
            )
        )
    )
    weekly = slots.withColumn("week_end", week_ending_friday(F.col("date")))
    first = F.min(F.struct("pos", "prev_date")).over(Window.partitionBy("week_end"))
    return weekly.withColumn("first", first).select(
        "date",
        "pos",
        "week_end",
        "prev_date",
        "next_date",
        F.coalesce(
            week_ending_friday(F.col("next_date")) != F.col("week_end"), F.lit(True)
        ).alias("is_rebalance"),
        F.when(F.col("first.pos") > 0, F.col("first.pos") - 1).alias("active_signal_pos"),
        F.col("first.prev_date").alias("active_signal_date"),
    )


def rebalance_dates(calendar: DataFrame) -> DataFrame:
    """Signal dates with the next slot as execution date.

    A signal on the very last slot has no execution date and gives no order.
    ``replaced_signal_pos`` is the signal whose holdings the new ones replace.
    """
    live = calendar.where(F.col("is_rebalance") & F.col("next_date").isNotNull())
    return live.select(
        F.col("pos").alias("signal_pos"),
        F.col("date").alias("signal_date"),
        F.col("next_date").alias("execution_date"),
        F.col("week_end"),
        F.col("active_signal_pos").alias("replaced_signal_pos"),
    )
