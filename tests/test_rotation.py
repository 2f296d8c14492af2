import math

import pytest
from pyspark.sql import functions as F

from panelwright.operators.calendar import slot_calendar
from panelwright.plans.rotation import (
    RotationConfig,
    rotation_report,
    rotation_signals,
    run_rotation,
)


@pytest.fixture(scope="module")
def result(formula_prices):
    return run_rotation(formula_prices, "BOND")


def test_signals_are_null_before_their_windows_fill(formula_prices):
    calendar = slot_calendar(formula_prices)
    signals = rotation_signals(formula_prices, calendar)
    early = signals.where("pos < 119").agg(
        F.count("score").alias("scores"), F.count("trend").alias("trends")
    )
    assert tuple(early.first()) == (0, 0)
    assert signals.where("pos >= 119").agg(F.count("trend")).first()[0] == 3 * (320 - 119)


def test_execution_follows_the_signal(result):
    assert result.orders.where("execution_date <= signal_date").count() == 0
    weights = {}
    for row in result.weights.collect():
        weights.setdefault(row.pos, {})[row.symbol] = row.weight
    slots = {row.date: row.pos for row in result.daily.select("date", "pos").collect()}
    for order in result.orders.collect():
        pos = slots[order.signal_date]
        assert weights.get(pos, {}) == weights.get(pos - 1, {})
        expected = {name: 1 / len(order.selected) for name in order.selected}
        assert weights[slots[order.execution_date]] == expected


def test_nav_is_finite_and_costs_are_not_negative(result):
    rows = result.daily.orderBy("pos").collect()
    assert len(rows) == 320
    assert all(math.isfinite(row.nav) for row in rows)
    assert all(row.cost >= 0 for row in rows)
    assert [row.date for row in rows] == sorted(row.date for row in rows)
    assert rows[0].turnover == 0


def test_nav_matches_a_direct_recomputation(result, formula_prices):
    prices = {}
    for row in formula_prices.collect():
        prices.setdefault(row.symbol, {})[row.date] = row.close
    daily = result.daily.orderBy("pos").collect()
    weights = {}
    for row in result.weights.collect():
        weights.setdefault(row.date, {})[row.symbol] = row.weight
    nav, before = 1.0, {}
    for previous, row in zip([None, *daily], daily, strict=False):
        now = weights.get(row.date, {})
        gross = 0.0
        if previous is not None:
            gross = sum(
                w * (prices[s][row.date] / prices[s][previous.date] - 1) for s, w in now.items()
            )
        moved = sum(abs(now.get(s, 0) - before.get(s, 0)) for s in {*now, *before})
        nav *= 1 + gross - moved * 10 / 10_000
        assert row.gross_return == pytest.approx(gross, abs=1e-12)
        assert row.turnover == pytest.approx(moved, abs=1e-12)
        assert row.nav == pytest.approx(nav, rel=1e-12)
        before = now


def test_report_and_flat_fallback(formula_prices, tmp_path):
    # Nothing rises above its average: the defensive asset is held at full weight.
    falling = formula_prices.withColumn(
        "close", F.when(F.col("symbol") == "BOND", 100.0).otherwise(1.0 + 1000.0 / F.col("close"))
    ).where("symbol <> 'RISK2' AND date < '2020-06-01'")
    spoiled = falling.unionByName(
        falling.limit(1).selectExpr("'X' AS symbol", "date", "double('NaN') AS close")
    )
    config = RotationConfig(momentum_window=5, volatility_window=3, trend_window=4)
    result = rotation_report(spoiled, "BOND", str(tmp_path), config)
    assert {tuple(r.selected) for r in result.orders.collect()} == {("BOND",)}
    assert {(r.symbol, r.weight) for r in result.weights.collect()} == {("BOND", 1.0)}
    spark = formula_prices.sparkSession
    assert spark.read.json(f"{tmp_path}/summary").first().total_return < 0
    daily = spark.read.option("header", True).csv(f"{tmp_path}/daily")
    assert daily.count() == falling.select("date").distinct().count()


def test_unknown_defensive_asset_is_an_error(formula_prices):
    with pytest.raises(ValueError):
        run_rotation(formula_prices, "CASH")


def test_future_bars_do_not_change_past_weights(formula_prices):
    config = RotationConfig(
        top_n=1, momentum_window=10, volatility_window=5, trend_window=20
    )
    cut = formula_prices.where("date < '2020-09-01'")
    whole = run_rotation(formula_prices, "BOND", config).weights
    part = run_rotation(cut.orderBy(F.rand(7)), "BOND", config).weights
    columns = ["date", "symbol", "weight"]
    past = whole.where("date < '2020-09-01'").select(*columns)
    assert part.count() > 100
    assert past.exceptAll(part.select(*columns)).count() == 0
    assert part.select(*columns).exceptAll(past).count() == 0
