import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright import schemas
from panelwright.functions.classify import asset_class
from panelwright.functions.text import general_number, market_prefix, padded_symbol
from panelwright.operators.asof import asof_backward
from panelwright.operators.cleaning import keep_last
from panelwright.operators.ranks import exact_quantiles
from panelwright.plans.adjustment import adjustment_totals, build_total_return
from panelwright.plans.ingest import ingest_coverage
from panelwright.plans.quality import (
    build_bars,
    build_research_universe,
    build_snapshot,
    export_snapshot,
    quality_summary,
    research_universe,
    snapshot_totals,
    universe_snapshot,
)
from panelwright.sources.normalize import (
    normalize_bars,
    normalize_catalog,
    normalize_series,
)

D = dt.date
RAW = (
    "symbol string, date date, open double, high double, low double, close double, "
    "volume double, amount double, ingest_seq long"
)


@pytest.fixture(scope="module")
def built(spark):
    def row(symbol, day, close, volume=1.0, amount=1.0, seq=0):
        return (symbol, day, None, None, None, close, volume, amount, seq)

    rows = [
        # A: duplicates, NULL dates, NULL and non-positive closes
        row("A", D(2024, 1, 1), 10.0, seq=1),
        row("A", D(2024, 1, 1), 11.0, seq=2),
        row("A", D(2024, 1, 1), float("nan"), seq=3),
        row("A", None, 5.0, seq=4),
        row("A", None, 6.0, seq=5),
        row("A", D(2024, 1, 2), 0.0, volume=None, amount=None, seq=6),
        row("A", D(2024, 1, 5), -1.0, volume=0.0, amount=3.0, seq=7),
        # B: nothing valid
        row("B", D(2024, 1, 1), None),
    ]
    # C: seventy rows, the first ten far more liquid than the last sixty
    for t in range(70):
        day = D(2024, 2, 1) + dt.timedelta(days=t)
        rows.append(row("C", day, 1.0, amount=1e9 if t < 10 else float(t), seq=t))
    raw = spark.createDataFrame(rows, RAW)
    catalog = spark.createDataFrame([("A", "国债ETF"), ("C", "沪深300")], "symbol string, name string")
    inventory = spark.createDataFrame([(s,) for s in "ABCZ"], "symbol string")
    return raw, build_bars(raw, catalog, inventory)


def test_cleaning_keeps_the_last_valid_row(built):
    raw, result = built
    kept = {r.date: r.close for r in result.bars.where("symbol = 'A'").collect()}
    # Non-positive closes are counted in the audit, not removed.
    assert kept == {D(2024, 1, 1): 11.0, D(2024, 1, 2): 0.0, D(2024, 1, 5): -1.0}
    assert keep_last(raw).exceptAll(result.bars).count() == 0


def test_quality_audit(built):
    rows = {r.symbol: r for r in built[1].quality.collect()}
    a = rows["A"]
    assert (a.rows_raw, a.rows_valid, a.duplicate_dates) == (7, 3, 3)
    assert (a.null_close, a.non_positive_close, a.span_days) == (1, 3, 4)
    assert (a.median_amount_60d, a.zero_volume_ratio_60d) == (2.0, pytest.approx(2 / 3))
    assert (a.name, a.asset_class) == ("国债ETF", "bond")
    b, z = rows["B"], rows["Z"]
    assert (b.rows_raw, b.rows_valid, b.first_date, b.median_amount_60d) == (1, 0, None, 0.0)
    assert (z.rows_raw, z.zero_volume_ratio_60d, z.name) == (0, 1.0, "Z")
    assert rows["C"].median_amount_60d == 39.5
    assert rows["C"].asset_class == "equity_broad"


def test_keep_first_and_alias_headers(spark):
    frame = spark.createDataFrame(
        [
            ("2024-01-02", "2.5", "7", 0),
            ("2024-01-02", "9", "8", 1),
            ("bad", "1", "1", 2),
            ("20240103", "x", "1", 3),
            ("2024/1/4", "3", "", 4),
        ],
        "`日期` string, `收盘` string, `成交额` string, n long",
    )
    rows = normalize_bars(frame, "510300", order="n").orderBy("date").collect()
    assert [(r.date, r.close, r.amount, r.open) for r in rows] == [
        (D(2024, 1, 2), 2.5, 7.0, None),
        (D(2024, 1, 4), 3.0, None, None),
    ]
    nav = frame.withColumnsRenamed({"日期": "净值日期", "收盘": "单位净值"})
    assert normalize_series(nav, "n", "nav").orderBy("date").first().nav == 2.5
    with pytest.raises(ValueError):
        normalize_bars(frame.drop("收盘"), "510300", order="n")


def test_numbers_and_symbols(spark):
    frame = spark.createDataFrame(
        [("15", "1e3"), ("600000", "1d"), ("1234567", "NaN"), ("160001", " 2 ")],
        "s string, v string",
    )
    from panelwright.functions.numbers import to_number

    rows = frame.select(
        padded_symbol(F.col("s")).alias("s"),
        to_number(F.col("v")).alias("v"),
        market_prefix(F.col("s")).alias("m"),
    ).collect()
    assert [r.s for r in rows] == ["000015", "600000", "1234567", "160001"]
    assert [r.v for r in rows] == [1000.0, None, None, 2.0]
    assert [r.m for r in rows] == ["sz", "sh", "sh", "sz"]
    assert general_number(10_000_000.0) == "1e+07"
    listed = spark.createDataFrame([("15", "x", 2), ("15", "y", 1)], "code string, name string, n int")
    assert [tuple(r) for r in normalize_catalog(listed, "n").collect()] == [("000015", "y")]


def test_bare_numbers_are_no_dates(spark):
    texts = ["45000", "12345", "2024", " 2024-01-05 ", "20240105", "2024/1/5", "2024-1-5", "2024-01-05 10:00:00", "x2024-01-05"]
    from panelwright.functions.numbers import to_day

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    day = D(2024, 1, 5)
    assert [r.d for r in frame.select(to_day(F.col("t")).alias("d")).collect()] == [
        None, None, None, day, day, day, day, day, None,
    ]


def test_first_matching_rule_wins(spark):
    names = ["货币债", "信用债", "黄金300", "恒生红利", "红利300", "中证500", "半导体", None, "纳指QDII"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    labels = [r.c for r in frame.select(asset_class(F.col("n")).alias("c")).collect()]
    assert labels == [
        "cash",
        "bond",
        "commodity",
        "overseas",
        "equity_dividend",
        "equity_broad",
        "equity_thematic",
        "equity_thematic",
        "overseas",
    ]


QUALITY_ROWS = [
    ("a", "equity_broad", 300, D(2024, 6, 30), 2e7),
    ("b", "equity_broad", 100, D(2024, 6, 30), 1.0),
    ("c", "cash", 300, D(2024, 5, 30), 2e7),
    ("d", "bond", 0, None, None),
    ("e", "bond", 400, D(2024, 5, 31), 1e7),
    ("f", "cash", 300, D(2024, 6, 29), 3e7),
    ("g", "equity_broad", 300, D(2024, 6, 29), 5e7),
]


@pytest.fixture(scope="module")
def quality(spark):
    schema = (
        "symbol string, asset_class string, rows_valid long, last_date date, "
        "median_amount_60d double"
    )
    frame = spark.createDataFrame(QUALITY_ROWS, schema)
    return frame.withColumns({"name": F.col("symbol"), "first_date": F.lit(None).cast("date")})


def test_snapshot_reasons(quality):
    rows = export_snapshot(universe_snapshot(quality)).collect()
    reasons = {r.symbol: r.exclusion_reason for r in rows}
    assert reasons == {
        "a": "",
        "b": "history<252;amount<1e+07",
        "c": "stale>30d;excluded_asset_class",
        "d": "history<252",  # NULL date and amount are no reasons of their own
        "e": "",
        "f": "excluded_asset_class",
        "g": "",
    }
    assert [r.symbol for r in rows] == ["e", "g", "a", "d", "f", "c", "b"]
    totals = snapshot_totals(universe_snapshot(quality)).first()
    assert (totals.as_of, totals.total, totals.eligible, totals.excluded) == (
        D(2024, 6, 30),
        7,
        3,
        4,
    )
    assert totals.eligible_by_asset_class == {"bond": 1, "equity_broad": 2}


def test_research_universe(quality):
    chosen = research_universe(quality, per_category=1, cash_count=1).collect()
    assert {r.symbol for r in chosen} == {"g", "e", "f"}


def test_quality_summary(quality):
    summary = quality_summary(quality, quality.limit(3)).first()
    assert (summary.catalog_count, summary.valid_count, summary.total_daily_rows) == (3, 6, 1700)
    assert summary.median_history_rows == 300
    assert summary.amount_q50 == 2e7
    assert summary.asset_class_counts == {"bond": 2, "cash": 2, "equity_broad": 3}


@pytest.fixture(scope="module")
def asof_tables(spark):
    bars = spark.createDataFrame(
        [("A", D(2024, 1, d), float(d)) for d in range(1, 11)]
        + [("B", D(2024, 1, 5), 5.0), ("N", D(2024, 1, 5), 5.0), ("E", D(2024, 1, 5), 5.0)],
        "symbol string, date date, close double",
    )
    factors = spark.createDataFrame(
        [
            ("A", D(2024, 1, 3), 2.0, 0.5),
            ("A", D(2024, 1, 6), None, 1.0),  # split unknown: counts as 1, not as the last 2
            ("A", D(2024, 1, 9), 4.0, None),
            ("B", D(2024, 1, 6), 9.0, 9.0),
        ],
        "symbol string, date date, s double, u double",
    )
    return bars, factors


def test_adjusted_prices(asof_tables, spark):
    bars, factors = asof_tables
    inventory = spark.createDataFrame([("A",), ("B",), ("E",)], "symbol string")
    result = build_total_return(bars, factors, inventory)
    rows = {(r.symbol, r.date.day): r.total_return_proxy for r in result.adjusted.collect()}
    assert [rows["A", d] for d in range(1, 11)] == [
        1.0,
        2.0,
        6.5,  # a factor of the same day counts
        8.5,
        10.5,
        7.0,
        8.0,
        9.0,
        36.0,
        40.0,
    ]
    assert rows["B", 5] == rows["E", 5] == 5.0
    assert ("N", 5) not in rows
    assert [r.symbol for r in result.missing.collect()] == ["N"]
    assert tuple(adjustment_totals(bars, result).first()) == (3, 1)


def test_bucketed_asof_equals_plain(spark):
    left = spark.range(400).selectExpr(
        "IF(id % 3 = 0, 'hot', string(id % 5)) AS k", "int(id * 7 % 211) AS t", "id"
    )
    right = spark.range(90).selectExpr(
        "IF(id % 2 = 0, 'hot', string(id % 5)) AS k", "int(id * 13 % 199) AS t", "id AS v",
        "IF(id % 4 = 0, NULL, id) AS w",
    )
    plain = asof_backward(left, right, "k", "t", ["v", "w"])
    cut = asof_backward(
        left, right, "k", "t", ["v", "w"], F.floor(F.col("t") / 10), hot_key_rows=100
    )
    assert plain.count() == 400
    assert plain.exceptAll(cut).count() == cut.exceptAll(plain).count() == 0
    rights = {}
    for r in right.collect():
        rights.setdefault(r.k, []).append((r.t, r.v, r.w))
    for r in plain.collect():
        known = [x for x in rights.get(r.k, []) if x[0] <= r.t]
        last = max(known, key=lambda x: (x[0], x[1])) if known else (None, None, None)
        assert (r.v, r.w) == last[1:]


def test_asof_ties_follow_the_order_and_nulls_match_nothing(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", None, 2), (None, 5, 3), ("b", 9, 4)], "k string, t int, id int")
    right = spark.createDataFrame(
        [("a", 3, 7, 2), ("a", 3, 1, 3), ("a", 3, 9, 1), ("a", None, 50, 9), (None, 3, 60, 9), ("b", 4, 5, None)],
        "k string, t int, v int, n int",
    )
    expected = {1: 1, 2: None, 3: None, 4: 5}
    for options in ({}, {"bucket": F.floor(F.col("t") / 2), "hot_key_rows": 2}):
        got = asof_backward(left, right, "k", "t", ["v"], order="n", **options)
        assert {r.id: r.v for r in got.collect()} == expected
    unordered = asof_backward(left, right, "k", "t", ["v"])
    assert {r.id: r.v for r in unordered.collect()} == expected | {1: 9}


def test_exact_quantiles_of_ties_and_nulls(spark):
    values = [5.0] * 400 + [float(k) for k in range(101)] + [None] * 7
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    known = sorted(v for v in values if v is not None)
    shares = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(frame, "x", shares)
    for share, value in zip(shares, got, strict=True):
        at = share * (len(known) - 1)
        low = known[int(at)]
        high = known[min(int(at) + 1, len(known) - 1)]
        assert value == pytest.approx(low + (high - low) * (at - int(at)))
    assert exact_quantiles(frame.where("x > 1000"), "x", [0.5]) == [None]


def test_snapshot_and_pool_jobs_write_reports(spark, quality, tmp_path):
    stored = quality.select(
        *[F.col(c) if c in quality.columns else F.lit(None).alias(c) for c in schemas.column_names(schemas.QUALITY)]
    )
    kinds = dict(f.split() for f in schemas.QUALITY.split(", "))
    stored.select(*[F.col(c).cast(k) for c, k in kinds.items()]).write.parquet(str(tmp_path / "quality"))
    build_snapshot(spark, str(tmp_path / "quality"), str(tmp_path))
    build_research_universe(spark, str(tmp_path / "quality"), str(tmp_path), per_category=1, cash_count=1)
    report = spark.read.option("header", True).csv(str(tmp_path / "snapshot"))
    assert {r.symbol for r in report.where("eligible = 'true'").collect()} == {"a", "e", "g"}
    totals = spark.read.json(str(tmp_path / "snapshot_totals")).first()
    assert (totals.total, totals.eligible, totals.eligible_by_asset_class.bond) == (7, 3, 1)
    pool = spark.read.option("header", True).csv(str(tmp_path / "research_universe"))
    assert {r.symbol for r in pool.collect()} == {"g", "e", "f"}
    chosen = spark.read.json(str(tmp_path / "research_totals")).first()
    assert (chosen.as_of, chosen.selected) == ("2024-06-30", 3)


def test_ingest_coverage(spark):
    catalog = spark.createDataFrame(
        [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "symbol string, name string"
    )
    inventory = spark.createDataFrame(
        [("1", 10, 5), ("2", 0, 0), ("3", 7, 0)], "symbol string, bytes long, rows long"
    )
    results = spark.createDataFrame(
        [("3", "cc", 0, "", "failed", "boom"), ("2", "b", 4, "vendor", "ok", "")],
        "symbol string, name string, rows long, source string, status string, error string",
    )
    run = ingest_coverage(catalog, inventory, results)
    rows = {r.symbol: tuple(r)[1:] for r in run.report.collect()}
    assert rows == {
        "1": ("a", 5, "existing", "ok", ""),
        "2": ("b", 4, "vendor", "ok", ""),
        "3": ("cc", 0, "", "failed", "boom"),
        "4": ("d", 0, "", "failed", "未找到历史文件"),
    }
    assert {r.symbol for r in run.failed.collect()} == {"3", "4"}
    assert [r.symbol for r in run.waiting.collect()] == ["4"]
    totals = run.totals.first()
    assert (totals.catalog, totals.success, totals.failed, totals.pending) == (4, 2, 2, 1)
