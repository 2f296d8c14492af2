"""Daily multipliers on a portfolio: breadth gate, volatility target, drawdown stop.

All rows are (scenario_id, pos) series, one entry per calendar date, so a scenario's window is
bounded by the calendar and scenarios run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelwright.functions.folds import stop_switches
from panelwright.functions.numbers import annualised, clip_unit, ratio

def by_scenario() -> WindowSpec:
    return Window.partitionBy("scenario_id").orderBy("pos")


def breadth_gate(breadth: Column, threshold: Column) -> Column:
    """1 when the previous date's breadth reaches the threshold, else 0; always 1 without one."""
    passed = F.coalesce(F.lag(breadth).over(by_scenario()) >= threshold, F.lit(False))
    return F.when((threshold <= 0) | passed, F.lit(1.0)).otherwise(F.lit(0.0))


def vol_scale(gross: Column, target: Column, window: int = 60, minimum: int = 20) -> Column:
    """Target over realised volatility up to the previous date, clipped to [0, 1]."""
    frame = by_scenario().rowsBetween(-(window - 1), Window.currentRow)
    realised = F.when(
        F.count(gross).over(frame) >= minimum, annualised(F.stddev_samp(gross).over(frame))
    )
    return ratio(target, realised)


def lagged_scale(scale: Column, target: Column) -> Column:
    applied = F.coalesce(clip_unit(F.lag(scale).over(by_scenario())), F.lit(1.0))
    return F.when(target > 0, applied).otherwise(F.lit(1.0))


def drawdown_stop(rows: DataFrame, gross: str, reentry: str = "breadth") -> DataFrame:
    """Add ``stopped`` to rows with ``stop_drawdown`` and ``stop_reentry_breadth``.

    ``reentry`` is the breadth that a stopped portfolio must see to resume, the same date's by
    default. Of each scenario's series, one entry per calendar date, only what the fold reads is
    gathered. Its switches come back as rows and are carried forward, one step per date.
    """
    day = F.struct("pos", F.col(gross).alias("gross"), F.col(reentry).alias("breadth"))
    folded = (
        rows.where("stop_drawdown > 0")
        .groupBy("scenario_id")
        .agg(
            F.sort_array(F.collect_list(day)).alias("series"),
            F.first("stop_drawdown").alias("limit"),
            F.first("stop_reentry_breadth").alias("reentry"),
        )
        .select(
            "scenario_id", stop_switches(F.col("series"), F.col("limit"), F.col("reentry")).alias("switches")
        )
    )
    switches = folded.select("scenario_id", F.inline("switches"))
    carried = F.last("stopped", ignorenulls=True).over(
        by_scenario().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = rows.join(switches, ["scenario_id", "pos"], "left")
    return marked.withColumn("stopped", F.coalesce(carried, F.lit(False)))
