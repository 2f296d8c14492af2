import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.operators import rolling
from panelwright.operators.calendar import rebalance_dates, slot_calendar
from panelwright.operators.panel import attach_slots, densify, drop_empty_dates, require_unique

D = dt.date


def days(spark, values):
    return spark.createDataFrame([(v,) for v in values], "date date")


def test_weeks_run_from_saturday_to_friday(spark):
    dates = [
        D(2024, 1, 3),  # Wednesday
        D(2024, 1, 5),  # Friday
        D(2024, 1, 6),  # Saturday: next week
        D(2024, 1, 7),  # Sunday
        D(2024, 1, 11),  # Thursday, no bar on Friday
        D(2024, 1, 24),  # a week is skipped
        D(2024, 1, 25),
    ]
    rows = {r.date: r for r in slot_calendar(days(spark, dates * 2)).collect()}
    assert [rows[d].pos for d in dates] == list(range(7))
    assert rows[D(2024, 1, 6)].week_end == rows[D(2024, 1, 7)].week_end == D(2024, 1, 12)
    assert [d for d in dates if rows[d].is_rebalance] == [dates[1], dates[4], dates[6]]
    assert [rows[d].active_signal_pos for d in dates] == [None, None, 1, 1, 1, 4, 4]
    assert rows[dates[5]].active_signal_date == dates[4]


def test_last_slot_gives_no_order(spark):
    calendar = slot_calendar(days(spark, [D(2024, 1, 5), D(2024, 1, 12), D(2024, 1, 19)]))
    orders = rebalance_dates(calendar).orderBy("signal_pos").collect()
    assert [(o.signal_date, o.execution_date, o.replaced_signal_pos) for o in orders] == [
        (D(2024, 1, 5), D(2024, 1, 12), None),
        (D(2024, 1, 12), D(2024, 1, 19), 0),
    ]


@pytest.fixture(scope="module")
def gappy(spark):
    """A is complete, B lists late and has a gap, C stops early; 40 dates."""
    start = D(2024, 1, 1)
    rows = []
    for t in range(40):
        day = start + dt.timedelta(days=t)
        rows.append(("A", day, 50.0 if 10 <= t < 25 else 50.0 + t % 7, 10.0 + t % 5))
        if t >= 6 and t != 20:
            rows.append(("B", day, 20.0 + (t * t) % 11, float(t * 37 % 13)))
        if t < 15:
            rows.append(("C", day, 0.0 if t == 5 else 5.0 + t, None if t == 3 else 1.0))
    return spark.createDataFrame(rows, "symbol string, date date, close double, amount double")


def test_dense_panel_has_every_slot_once(gappy):
    dense = densify(gappy, slot_calendar(gappy)).collect()
    assert len(dense) == 3 * 40
    assert len({(r.symbol, r.pos) for r in dense}) == 3 * 40
    filled = {(r.symbol, r.date): (r.close, r.amount) for r in dense if r.close is not None}
    assert filled == {(r.symbol, r.date): (r.close, r.amount) for r in gappy.collect()}


def _measures(rows):
    close = F.col("close")
    averaged = rolling.with_moving_averages(rows, "close", {"ma_4": 4, "ma_9": 9, "ma_1": 1})
    medians = rolling.with_moving_median(averaged, "amount", "median_4", 4)
    medians = rolling.with_moving_median(medians, "amount", "median_3", 3)
    measured = medians.select(
        "symbol",
        "pos",
        "date",
        "close",
        rolling.simple_return(close).alias("ret"),
        rolling.simple_return(close, 5).alias("momentum"),
        "ma_1",
        "ma_4",
        "ma_9",
        "median_3",
        "median_4",
        rolling.history_count(close).alias("history"),
        rolling.stale_days(close, F.col("date")).alias("stale"),
    )
    return measured.withColumn("vol", rolling.volatility(F.col("ret"), 4))


def test_sparse_rows_and_dense_panel_give_the_same_measures(gappy):
    calendar = slot_calendar(gappy)
    sparse = _measures(attach_slots(gappy, calendar)).orderBy("symbol", "pos").collect()
    dense = _measures(densify(gappy, calendar))
    assert sparse == dense.where("close IS NOT NULL").orderBy("symbol", "pos").collect()
    # Empty slots carry no signal, only history and growing staleness.
    empty = dense.where("close IS NULL").collect()
    assert all(r.ret is r.momentum is r.ma_4 is r.vol is r.median_3 is None for r in empty)
    last_c = [r.stale for r in sorted(empty, key=lambda r: r.pos) if r.symbol == "C"]
    assert last_c == list(range(1, 26))


def test_measures_match_their_definitions(gappy):
    closes, amounts = {}, {}
    for r in gappy.collect():
        closes[r.symbol, (r.date - D(2024, 1, 1)).days] = r.close
        amounts[r.symbol, (r.date - D(2024, 1, 1)).days] = r.amount
    rows = _measures(attach_slots(gappy, slot_calendar(gappy))).collect()

    def window(values, symbol, pos, size):
        found = [values.get((symbol, p)) for p in range(pos - size + 1, pos + 1)]
        return None if None in found else found

    def returns(symbol, pos):
        now, before = closes.get((symbol, pos)), closes.get((symbol, pos - 1))
        return None if now is None or not before else now / before - 1

    for r in rows:
        for size in (1, 4, 9):
            full = window(closes, r.symbol, r.pos, size)
            got = r[f"ma_{size}"]
            assert got == (None if full is None else pytest.approx(sum(full) / size, rel=1e-14))
        for size in (3, 4):
            full = window(amounts, r.symbol, r.pos, size)
            ordered = sorted(full) if full else None
            middle = ordered and (ordered[(size - 1) // 2] + ordered[size // 2]) / 2
            assert r[f"median_{size}"] == middle
        assert r.ret == returns(r.symbol, r.pos)
        history = [returns(r.symbol, p) for p in range(r.pos - 3, r.pos + 1)]
        if None in history:
            assert r.vol is None
        else:
            mean = sum(history) / 4
            var = sum((h - mean) ** 2 for h in history) / 3
            assert r.vol == pytest.approx((var * 252) ** 0.5, abs=1e-12)
    # A zero previous close gives no return instead of infinity.
    assert closes["C", 5] == 0 and returns("C", 6) is None


def test_flat_window_is_not_above_its_average(spark):
    rows = spark.range(300).select(
        F.lit("X").alias("symbol"), F.col("id").cast("int").alias("pos"), F.lit(0.1).alias("close")
    )
    averaged = rolling.with_moving_averages(rows, "close", {"ma": 120, "mb": 7})
    assert averaged.where("ma IS NOT NULL").count() == 181
    assert averaged.where("close <> ma OR close <> mb").count() == 0


def test_bad_price_does_not_spoil_later_averages(spark):
    close = F.when(F.col("id") == 10, 1e18).otherwise(1.0 + F.col("id") % 3)
    rows = spark.range(200).select(
        F.lit("X").alias("symbol"), F.col("id").cast("int").alias("pos"), close.alias("close")
    )
    averaged = rolling.with_moving_averages(rows, "close", {"ma": 6}).where("pos >= 30")
    assert averaged.where("abs(ma - 2.0) > 1e-9").count() == 0


def test_duplicate_panel_keys_are_an_error(gappy):
    assert require_unique(gappy) is gappy
    with pytest.raises(ValueError):
        require_unique(gappy.unionByName(gappy.limit(1)))


def test_dense_panel_refuses_duplicate_keys(gappy):
    twice = gappy.unionByName(gappy.limit(1))
    with pytest.raises(Exception, match="duplicate symbol, date"):
        densify(twice, slot_calendar(gappy)).collect()


def test_averages_shuffle_the_panel_once(spark):
    rows = spark.range(1000).selectExpr("string(id % 5) AS symbol", "int(id / 5) AS pos", "double(id) AS close")
    plan = rolling.with_moving_averages(rows, "close", {"ma": 20})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_dates_without_any_price_are_dropped(spark):
    rows = spark.createDataFrame(
        [
            ("A", D(2024, 1, 1), 1.0),
            ("B", D(2024, 1, 1), None),
            ("A", D(2024, 1, 2), None),
            ("B", D(2024, 1, 2), None),
        ],
        "symbol string, date date, close double",
    )
    kept = drop_empty_dates(rows).collect()
    assert sorted((r.symbol, r.date) for r in kept) == [
        ("A", D(2024, 1, 1)),
        ("B", D(2024, 1, 1)),
    ]
