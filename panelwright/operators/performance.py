"""From target weights to daily returns, turnover, cost, NAV and summary metrics.

Targets stay one row per (target, signal, name). Overlays only multiply a whole portfolio by a
number per date, so the weight matrix (dates by symbols) is never built: the unscaled gross
return is summed once per target and multiplied, and turnover needs names only on execution
dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.numbers import annualised, ratio
from panelwright.operators.overlays import by_scenario

DAYS_PER_YEAR = 365.25
BASIS_POINTS = 10_000.0
DAILY = ("gross_return", "turnover", "cost", "net_return", "nav")


def daily_weights(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Targets spread over their holding slots: from the slot after the signal up to and
    including the slot of the next signal. Zero weights are left out."""
    held = calendar.select("date", "pos", F.col("active_signal_pos").alias("signal_pos"))
    return targets.join(held, "signal_pos").select(
        "target_id", "date", "pos", "signal_pos", "symbol", "weight"
    )


def unit_gross(targets: DataFrame, returns: DataFrame) -> DataFrame:
    """Sum of weight times return per (target, slot).

    ``returns`` has (symbol, active_signal_pos, pos, ret). The target table is small next to it
    and joins on equal (signal, symbol).
    """
    live = returns.where(F.col("ret").isNotNull()).select(
        "symbol", F.col("active_signal_pos").alias("signal_pos"), "pos", "ret"
    )
    return (
        live.join(targets, ["signal_pos", "symbol"])
        .groupBy("target_id", "pos")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("unit_gross"))
    )


def invested(targets: DataFrame) -> DataFrame:
    return targets.groupBy("target_id", F.col("signal_pos").alias("active_signal_pos")).agg(
        F.sum(F.abs("weight")).alias("invested")
    )


def switch_legs(targets: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Old and new weights of every name that is in either, per (target, execution slot).

    ``legs`` is array<struct(new, old)> with at most twice the portfolio size.
    """
    execution = (F.col("signal_pos") + 1).alias("pos")
    new = targets.join(rebalances.select("signal_pos"), "signal_pos").select(
        "target_id", execution, "symbol", F.col("weight").alias("new"), F.lit(0.0).alias("old")
    )
    replaced = rebalances.select(
        execution, F.col("replaced_signal_pos").alias("signal_pos")
    ).where(F.col("signal_pos").isNotNull())
    old = targets.join(replaced, "signal_pos").select(
        "target_id", "pos", "symbol", F.lit(0.0).alias("new"), F.col("weight").alias("old")
    )
    names = new.unionByName(old).groupBy("target_id", "pos", "symbol").agg(
        F.sum("new").alias("new"), F.sum("old").alias("old")
    )
    return names.groupBy("target_id", "pos").agg(
        F.sort_array(F.collect_list(F.struct("symbol", "new", "old"))).alias("legs")
    )


def turnover(legs: Column, invested_now: Column, multiplier: Column) -> Column:
    """Sum of absolute weight changes against the previous slot; 0 on the first slot."""
    before = F.lag(multiplier).over(by_scenario())
    switched = F.aggregate(
        legs,
        F.lit(0.0),
        lambda acc, leg: acc + F.abs(leg["new"] * multiplier - leg["old"] * before),
    )
    resized = F.abs(multiplier - before) * F.coalesce(invested_now, F.lit(0.0))
    return F.when(before.isNull(), F.lit(0.0)).otherwise(F.coalesce(switched, resized))


def cumulative_nav(net: Column) -> Column:
    running = by_scenario().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.product(1.0 + net).over(running)


def drawdown(nav: Column) -> Column:
    running = by_scenario().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ratio(nav, F.max(nav).over(running)) - 1.0


def daily_result(axis: DataFrame, legs: DataFrame, held: DataFrame) -> DataFrame:
    """Daily series from (scenario_id, target_id, pos, date, multiplier, unit_gross, ...)."""
    rows = axis.join(legs, ["target_id", "pos"], "left").join(
        held, ["target_id", "active_signal_pos"], "left"
    )
    priced = rows.select(
        "scenario_id",
        "date",
        "pos",
        (F.col("multiplier") * F.col("unit_gross")).alias("gross_return"),
        turnover(F.col("legs"), F.col("invested"), F.col("multiplier")).alias("turnover"),
        "cost_bps",
    )
    cost = F.col("turnover") * F.col("cost_bps") / BASIS_POINTS
    net = priced.withColumn("cost", cost).withColumn(
        "net_return", F.col("gross_return") - F.col("cost")
    )
    return net.withColumn("nav", cumulative_nav(F.col("net_return"))).select(
        "scenario_id", "date", "pos", *DAILY
    )


def summarize(daily: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of metrics per scenario."""
    rows = daily.withColumn("drawdown", drawdown(F.col("nav")))
    counted = orders.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("rebalance_count"))
    stats = rows.groupBy("scenario_id").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.max_by("nav", "pos").alias("last_nav"),
        annualised(F.stddev_samp("net_return")).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("average_daily_turnover"),
        F.sum("cost").alias("total_cost"),
    )
    years = F.greatest(
        F.datediff("end", "start") / F.lit(DAYS_PER_YEAR), F.lit(1.0 / DAYS_PER_YEAR)
    )
    grown = stats.withColumn(
        "annualized_return", F.pow("last_nav", F.lit(1.0) / years) - 1.0
    )
    calmar = F.when(
        F.col("max_drawdown") < 0, ratio(F.col("annualized_return"), -F.col("max_drawdown"))
    )
    return grown.join(counted, "scenario_id", "left").select(
        "scenario_id",
        "start",
        "end",
        (F.col("last_nav") - 1.0).alias("total_return"),
        "annualized_return",
        "annualized_volatility",
        "max_drawdown",
        calmar.alias("calmar"),
        "average_daily_turnover",
        "total_cost",
        F.coalesce("rebalance_count", F.lit(0).cast("long")).alias("rebalance_count"),
    )
