"""Baseline rotation: risk-adjusted momentum, trend filter, equal weights."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.folds import equal_weights
from panelwright.functions.numbers import finite, ratio
from panelwright.operators import performance, rolling
from panelwright.operators.calendar import rebalance_dates, slot_calendar
from panelwright.operators.panel import attach_slots, is_repeated, refuse_repeated
from panelwright.operators.selection import top_n, with_fallback
from panelwright.scratch import pin
from panelwright.sources import sinks

SCENARIO = "baseline"
TARGET = 0


@dataclass(frozen=True)
class RotationConfig:
    top_n: int = 3
    cost_bps: float = 10.0
    momentum_window: int = 60
    volatility_window: int = 20
    trend_window: int = 120


class RotationResult(NamedTuple):
    daily: DataFrame
    orders: DataFrame
    scores: DataFrame
    weights: DataFrame
    summary: DataFrame


def rotation_signals(
    prices: DataFrame, calendar: DataFrame, config: RotationConfig = RotationConfig()
) -> DataFrame:
    """Score and trend per existing (symbol, date) row; both NULL before their windows fill."""
    close = F.col("close")
    rows = attach_slots(prices, calendar, "is_rebalance", "next_date", "active_signal_pos")
    averaged = rolling.with_moving_averages(rows, "close", {"average": config.trend_window})
    measured = averaged.select(
        "symbol",
        "date",
        "pos",
        "is_rebalance",
        "next_date",
        "active_signal_pos",
        "close",
        rolling.simple_return(close).alias("ret"),
        rolling.simple_return(close, config.momentum_window).alias("momentum"),
        (close > F.col("average")).alias("trend"),
        is_repeated().alias("repeated"),
    )
    scored = measured.withColumn(
        "vol", rolling.volatility(F.col("ret"), config.volatility_window)
    )
    return scored.withColumn(
        "score", F.when(F.col("trend"), ratio(F.col("momentum"), F.col("vol")))
    )


def weekly_orders(
    signals: DataFrame, calendar: DataFrame, defensive: str, limit: int
) -> DataFrame:
    """Best names of every signal date, or the defensive one when none has a score."""
    live = signals.where("is_rebalance AND next_date IS NOT NULL AND score IS NOT NULL")
    picked = (
        top_n(live, ["pos"], limit)
        .groupBy(F.col("pos").alias("signal_pos"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "symbol"))).alias("picked"))
    )
    fallback = F.struct(F.lit(1).alias("rank"), F.lit(defensive).alias("symbol"))
    return (
        rebalance_dates(calendar)
        .join(picked, "signal_pos", "left")
        .withColumn("names", with_fallback(F.col("picked"), fallback))
        .drop("picked")
    )


def run_rotation(
    prices: DataFrame, defensive: str, config: RotationConfig = RotationConfig()
) -> RotationResult:
    """Weekly rotation over (symbol, date, close) rows; orders execute on the next slot."""
    known = prices.where(F.col("symbol") == defensive).limit(1)
    if known.isEmpty():
        raise ValueError(f"defensive asset {defensive!r} is not in the prices")
    closes = prices.select("symbol", "date", finite(F.col("close")).alias("close"))
    priced = closes.where(F.col("close").isNotNull())
    labels = {"scenario_id": F.lit(SCENARIO), "target_id": F.lit(TARGET)}
    calendar = pin(slot_calendar(priced).withColumns(labels), "calendar")
    signals = pin(
        rotation_signals(priced, calendar, config).select(
            "symbol",
            "date",
            "pos",
            "is_rebalance",
            "next_date",
            "active_signal_pos",
            "ret",
            "trend",
            "score",
            "repeated",
        ),
        "signals",
    )
    signals = refuse_repeated(signals)
    ordered = pin(
        weekly_orders(signals, calendar, defensive, config.top_n).withColumns(labels), "orders"
    )
    targets = pin(
        ordered.select("target_id", "signal_pos", F.inline(equal_weights(F.col("names")))),
        "targets",
    )
    gross = performance.unit_gross(targets, signals)
    axis = (
        calendar.select("scenario_id", "target_id", "pos", "date", "active_signal_pos")
        .join(gross, ["target_id", "pos"], "left")
        .select(
            "scenario_id",
            "target_id",
            "pos",
            "date",
            "active_signal_pos",
            F.lit(1.0).alias("multiplier"),
            F.coalesce("unit_gross", F.lit(0.0)).alias("unit_gross"),
            F.lit(float(config.cost_bps)).alias("cost_bps"),
        )
    )
    daily = performance.daily_result(
        axis,
        performance.switch_legs(targets, rebalance_dates(calendar)),
        performance.invested(targets),
    )
    orders = ordered.select(
        "scenario_id",
        "signal_date",
        "execution_date",
        F.transform("names", lambda n: n["symbol"]).alias("selected"),
    )
    return RotationResult(
        daily,
        orders,
        signals.select("symbol", "date", "pos", "score", "trend"),
        performance.daily_weights(targets, calendar),
        performance.summarize(daily, orders),
    )


def rotation_report(
    prices: DataFrame, defensive: str, output: str, config: RotationConfig = RotationConfig()
) -> RotationResult:
    """Run the rotation and write its daily series, orders and summary."""
    result = run_rotation(prices, defensive, config)
    sinks.write_run(result.daily.drop("pos"), result.orders, result.summary, output)
    return result
