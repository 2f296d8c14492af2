import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.folds import capped_inverse_vol, stop_switches
from panelwright.operators.selection import top_n, top_n_per_category


def weigh(spark, books, single, group):
    """books: list of lists of (symbol, asset_class, vol)."""
    rows = [(i, book) for i, book in enumerate(books)]
    schema = "id int, names array<struct<symbol:string,asset_class:string,vol:double>>"
    frame = spark.createDataFrame(rows, schema).select(
        "id",
        capped_inverse_vol(F.col("names"), F.lit(single), F.lit(group)).alias("weights"),
    )
    return {r.id: {w.symbol: w.weight for w in r.weights} for r in frame.collect()}


def test_capped_weights_golden_cases(spark):
    result = weigh(
        spark,
        [
            [("a", "x", 1 / 6), ("b", "x", 1 / 3), ("c", "y", 1.0)],
            [("a", "x", 0.2)],
            [("a", "w", 1 / 8), ("b", "x", 1.0), ("c", "y", 1.0), ("d", "z", 1.0)],
            [("a", "x", None), ("b", "y", 0.0)],
            [("a", "x", None), ("b", "y", 0.5)],
            [],
        ],
        0.30,
        0.40,
    )
    assert result[0] == pytest.approx({"a": 0.400007, "b": 0.299993, "c": 0.3}, abs=1e-6)
    assert result[1] == {"a": 1.0}
    assert result[2] == pytest.approx({"a": 0.3, "b": 0.7 / 3, "c": 0.7 / 3, "d": 0.7 / 3})
    assert result[3] == result[5] == {}
    assert result[4] == {"b": 1.0}


def test_caps_hold_when_there_is_room(spark):
    generator = random.Random(5)
    books = [
        [(f"s{i}", f"c{i % 5}", generator.uniform(0.05, 0.5)) for i in range(10)]
        for _ in range(40)
    ]
    for book, weights in weigh(spark, books, 0.25, 0.45).items():
        classes = {symbol: name for symbol, name, _ in books[book]}
        assert sum(weights.values()) == pytest.approx(1.0)
        assert max(weights.values()) <= 0.25 + 5e-3
        for name in set(classes.values()):
            held = sum(w for s, w in weights.items() if classes[s] == name)
            assert held <= 0.45 + 5e-3


def switches(spark, days, stop, reentry):
    schema = "series array<struct<pos:int,gross:double,breadth:double>>"
    frame = spark.createDataFrame([([(i, g, b) for i, (g, b) in enumerate(days)],)], schema)
    column = stop_switches(F.col("series"), F.lit(stop), F.lit(reentry))
    return [(s.pos, s.stopped) for s in frame.select(column.alias("s")).first().s]


def test_stop_and_reentry(spark):
    days = [(0.0, 0.0), (-0.05, 0.0), (-0.06, 0.0), (0.01, 0.0), (0.02, 0.6)]
    assert switches(spark, days, 0.10, 0.5) == [(3, True), (4, False)]


def test_reentry_below_the_high_water_mark_stops_again(spark):
    days = [(0.0, 1.0), (-0.2, 1.0), (0.0, 0.0), (0.01, 0.9), (0.0, 0.0), (0.0, None), (0.5, 0.9)]
    assert switches(spark, days, 0.10, 0.5) == [(2, True), (3, False), (4, True), (6, False)]


def test_first_day_never_stops(spark):
    assert switches(spark, [(-0.5, 0.0), (0.0, 0.0)], 0.10, 0.5) == [(1, True)]


def test_category_cap_equals_greedy_choice(spark):
    generator = random.Random(11)
    rows = []
    for key in range(60):
        for i in range(generator.randint(1, 15)):
            score = None if i == 14 else round(generator.uniform(-1, 1), 1)
            rows.append((key, f"s{i:02d}", f"c{generator.randint(0, 3)}", score or 0.0))
    frame = spark.createDataFrame(
        rows, "key int, symbol string, asset_class string, score double"
    )
    best = top_n_per_category(frame, ["key"], 5, 2).collect()
    got = {}
    for r in sorted(best, key=lambda r: (r.key, r["rank"])):
        got.setdefault(r.key, []).append(r.symbol)
    for key in range(60):
        taken, used = [], {}
        for _, symbol, name, _ in sorted(
            (r for r in rows if r[0] == key), key=lambda r: (-r[3], r[1])
        ):
            if len(taken) < 5 and used.get(name, 0) < 2:
                taken.append(symbol)
                used[name] = used.get(name, 0) + 1
        assert got[key] == taken


def test_ties_rank_by_symbol(spark):
    frame = spark.createDataFrame(
        [(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "key int, symbol string, score double"
    )
    assert [r.symbol for r in top_n(frame, ["key"], 2).orderBy("rank").collect()] == ["c", "a"]


def test_top_n_is_cut_before_the_shuffle(spark):
    frame = spark.range(10).selectExpr(
        "id % 2 AS key", "string(id) AS symbol", "double(id) AS score"
    )
    plan = top_n(frame, ["key"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]
