import datetime as dt
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from panelwright.plans.research import (
    Scenario,
    SignalSpec,
    market_by_date,
    research_report,
    research_signals,
    run_research,
)
from panelwright.operators.calendar import slot_calendar
from panelwright.operators.overlays import drawdown_stop
from panelwright.scratch import pin
from tests.conftest import business_days

D = dt.date
SPEC = SignalSpec(
    momentum=((3, 0.5), (5, 0.3), (8, 0.2)),
    vol_window=4,
    liquidity_window=4,
    realised_window=20,
    realised_minimum=5,
)
CLASSES = {
    "R1": "equity_broad",
    "R2": "equity_broad",
    "R3": "overseas",
    "R4": "commodity",
    "R5": "bond",
    "CASH": "cash",
    "LATE": "overseas",
    "GAPS": "commodity",
}
DAYS = business_days(D(2021, 1, 1), 120)


def scenario(name, **changes):
    shared = {
        "min_history_rows": 10,
        "min_median_amount_60d": 5.0,
        "trend_window": 6,
        "top_n": 3,
        "max_per_category": 2,
    }
    return Scenario(name, **(shared | changes))


SCENARIOS = [
    scenario("plain"),
    scenario("longer", trend_window=10, single_cap=0.5, category_cap=0.6),
    scenario("gate", breadth_threshold=0.5),
    scenario("vol", target_vol=0.1),
    scenario("stop", stop_drawdown=0.02, stop_reentry_breadth=0.6),
    scenario("nothing", min_median_amount_60d=1e9),
]


@pytest.fixture(scope="module")
def prices(spark):
    rows = []
    for t, day in enumerate(DAYS):
        for i, symbol in enumerate(CLASSES):
            if symbol == "LATE" and t < 50 or symbol == "GAPS" and t % 9 == 0:
                continue
            close = 100 + 8 * math.sin(t / (3 + i)) + 3 * math.cos(t * (i + 2) / 5) + 0.02 * t * i
            if symbol == "CASH":
                close = 100.0
            rows.append((symbol, day, close, 10.0 + (t * (i + 3)) % 17))
    schema = "symbol string, date date, close double, amount double"
    return pin(spark.createDataFrame(rows, schema), "test-prices")


@pytest.fixture(scope="module")
def classes(spark):
    known = [(s, c) for s, c in CLASSES.items() if s != "GAPS"]
    return spark.createDataFrame(known, "symbol string, asset_class string")


@pytest.fixture(scope="module")
def run(prices, classes):
    result = run_research({"raw": prices}, classes, SCENARIOS, SPEC)
    return result._replace(daily=result.daily.cache(), weights=result.weights.cache())


def by_scenario(frame, *order):
    grouped = {}
    for row in frame.orderBy("scenario_id", *order).collect():
        grouped.setdefault(row.scenario_id, []).append(row)
    return grouped


def test_every_scenario_has_every_date(run):
    daily = by_scenario(run.daily, "pos")
    assert {name: len(rows) for name, rows in daily.items()} == {
        s.scenario_id: 120 for s in SCENARIOS
    }
    for rows in daily.values():
        assert [r.date for r in rows] == DAYS
        assert rows[0].turnover == rows[0].gross_return == 0
        assert all(r.cost >= 0 and math.isfinite(r.nav) for r in rows)
        nav = 1.0
        for r in rows:
            nav *= 1 + r.net_return
            assert r.nav == pytest.approx(nav, rel=1e-12)


def test_overlays_take_effect(run):
    daily = by_scenario(run.daily, "pos")
    flat = {n: sum(r.gross_return == 0 for r in rows) for n, rows in daily.items()}
    assert flat["gate"] > flat["plain"] and flat["stop"] > flat["plain"]
    assert sum(r.turnover > 0 for r in daily["vol"]) > sum(r.turnover > 0 for r in daily["plain"])


def test_execution_follows_the_signal(run):
    weights = {}
    for r in run.weights.collect():
        weights.setdefault((r.scenario_id, r.pos), {})[r.symbol] = r.weight
    for order in run.orders.collect():
        pos = DAYS.index(order.signal_date)
        assert DAYS[pos + 1] == order.execution_date
        key = order.scenario_id
        assert weights.get((key, pos), {}) == weights.get((key, pos - 1), {})
        assert set(weights.get((key, pos + 1), {})) <= set(order.selected)
        assert order.selected_count == len(order.selected)


def test_gross_and_turnover_follow_from_the_weights(run, prices):
    closes = {(r.symbol, r.date): r.close for r in prices.collect()}
    for name in ("plain", "longer"):
        weights = {}
        for r in run.weights.where(F.col("scenario_id") == name).collect():
            weights.setdefault(r.pos, {})[r.symbol] = r.weight
        for r in run.daily.where(F.col("scenario_id") == name).collect():
            now, before = weights.get(r.pos, {}), weights.get(r.pos - 1, {})
            gross = 0.0
            for symbol, weight in now.items():
                pair = [closes.get((symbol, DAYS[p])) for p in (r.pos - 1, r.pos)]
                gross += weight * (pair[1] / pair[0] - 1) if None not in pair else 0.0
            moved = sum(abs(now.get(s, 0) - before.get(s, 0)) for s in {*now, *before})
            assert r.gross_return == pytest.approx(gross, abs=1e-12)
            assert r.turnover == pytest.approx(moved, abs=1e-12)


def test_fallback_is_the_first_priced_cash_or_bond(run):
    rows = run.orders.where("scenario_id = 'nothing'").collect()
    assert len(rows) > 20
    assert {tuple(r.selected) for r in rows} == {("CASH",)}
    # Cash never moves, so it has no volatility, no weight and no turnover: the book is flat.
    assert run.weights.where("scenario_id = 'nothing'").count() == 0
    assert run.daily.where("scenario_id = 'nothing' AND (nav <> 1 OR turnover <> 0)").count() == 0


def test_summary(run):
    rows = {r.scenario_id: r for r in run.summary.collect()}
    daily = by_scenario(run.daily, "pos")["plain"]
    plain = rows["plain"]
    navs = [r.nav for r in daily]
    peaks = [max(navs[: i + 1]) for i in range(len(navs))]
    assert plain.max_drawdown == pytest.approx(min(n / p - 1 for n, p in zip(navs, peaks)))
    years = (DAYS[-1] - DAYS[0]).days / 365.25
    assert plain.annualized_return == pytest.approx(navs[-1] ** (1 / years) - 1)
    assert plain.calmar == pytest.approx(plain.annualized_return / -plain.max_drawdown)
    assert plain.total_cost == pytest.approx(sum(r.cost for r in daily))
    assert plain.parameters["top_n"] == "3" and plain.price_mode == "raw"
    assert rows["nothing"].calmar is None
    assert rows["nothing"].rebalance_count == plain.rebalance_count > 20


def test_a_scenario_alone_shuffled_and_without_its_future_is_the_same(run, prices, classes):
    cut = DAYS[80]
    past = prices.where(F.col("date") < F.lit(cut)).orderBy(F.rand(3))
    alone = run_research({"raw": past}, classes, [SCENARIOS[4]], SPEC)
    columns = ["date", "symbol", F.round("weight", 12).alias("weight")]
    whole = run.weights.where(F.col("scenario_id") == "stop").where(F.col("date") < F.lit(cut))
    left, right = whole.select(*columns), alone.weights.select(*columns)
    assert right.count() > 50
    assert left.exceptAll(right).count() == right.exceptAll(left).count() == 0
    series = ["date", F.round("gross_return", 12).alias("g"), F.round("turnover", 12).alias("t")]
    # Breadth counts every risk symbol of the panel, and all are listed before the cut.
    before = run.daily.where(F.col("scenario_id") == "stop").where(F.col("date") < F.lit(cut))
    assert before.select(*series).exceptAll(alone.daily.select(*series)).count() == 0


def test_signals_keep_null_and_false_apart(prices, classes):
    calendar = slot_calendar(prices)
    signals = pin(research_signals(prices, classes, calendar, [6], SPEC), "test-signals")
    assert signals.where("trend_6 IS NULL").count() == 0
    assert signals.where("pos < 5 AND trend_6").count() == 0
    assert signals.where("symbol = 'GAPS' AND asset_class <> 'unknown'").count() == 0
    market = {r.pos: r for r in market_by_date(signals, calendar, [6], SPEC).collect()}
    rising = {r.pos: r.n for r in signals.where("asset_class <> 'cash' AND trend_6").groupBy(
        "pos").agg(F.count("*").alias("n")).collect()}
    # Seven risk symbols count from the first date on, the one listed late included.
    for pos, row in market.items():
        assert row.breadth_6 == pytest.approx(rising.get(pos, 0) / 7)


def test_report_files_and_warm_up(prices, classes, tmp_path):
    start = DAYS[30]
    research_report(
        prices,
        classes,
        [scenario("a"), scenario("b", price_mode="total-return", stop_drawdown=0.05)],
        str(tmp_path),
        adjusted=prices.select(
            "symbol", "date", (F.col("close") * 1.5 + 1).alias("total_return_proxy")
        ),
        symbols=["R1", "R2", "R3", "R5"],
        start=start.isoformat(),
        spec=SignalSpec(**{**SPEC.__dict__, "reentry_lag": 1}),
    )
    spark = prices.sparkSession
    orders = spark.read.option("header", True).csv(f"{tmp_path}/orders")
    # History before the start date is not seen: nothing qualifies until ten rows are there.
    early = orders.where(F.col("signal_date") < F.lit(DAYS[39].isoformat()))
    assert early.count() > 0 and {r.selected for r in early.collect()} == {"R5"}
    assert orders.where("selected_count > 1").count() > 0
    daily = spark.read.option("header", True).csv(f"{tmp_path}/daily")
    assert daily.groupBy("scenario_id").count().collect()[0]["count"] == 90
    lines = [line for f in tmp_path.glob("summary/*.json") for line in f.read_text().splitlines()]
    summaries = {row["scenario_id"]: row for row in map(json.loads, lines)}
    assert summaries["b"]["price_mode"] == "total-return"
    assert summaries["a"]["start"] == start.isoformat()


def test_a_repeated_date_is_an_error(prices, classes):
    twice = prices.unionByName(prices.where("symbol = 'R1'").limit(1))
    with pytest.raises(ValueError, match="duplicate symbol, date"):
        run_research({scenario("a").price_mode: twice}, classes, [scenario("a")], SPEC)


def test_the_stop_takes_time_in_step_with_the_days(spark):
    def seconds(days):
        rows = spark.range(days).select(
            F.lit("s").alias("scenario_id"),
            F.col("id").cast("int").alias("pos"),
            F.when(F.col("id") % 2 == 0, -0.2).otherwise(0.2).alias("gross"),
            F.lit(1.0).alias("breadth"),
            F.lit(0.05).alias("stop_drawdown"),
            F.lit(0.5).alias("stop_reentry_breadth"),
        )
        frame = pin(rows, "path")
        start = time.perf_counter()
        stopped = drawdown_stop(frame, "gross").where("stopped").count()
        assert stopped > days / 3
        return time.perf_counter() - start

    seconds(1300)
    assert seconds(10_400) < 6 * seconds(2_600) + 2
