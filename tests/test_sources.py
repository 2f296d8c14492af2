import datetime as dt
import gzip

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.plans.adjustment import build_total_return_from_files
from panelwright.plans.ingest import coverage_from_files
from panelwright.plans.quality import build_bars_from_files
from panelwright.sources import files, sinks, tables, wide
from workload.more_queries import volatility_of

D = dt.date
HEADER = "date,open,high,low,close,volume,amount\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ingest")
    bars = root / "history"
    bars.mkdir()
    (bars / "000001.csv").write_text(
        HEADER
        + "2024-01-02,1,1,1,1.5,10,100\n2024-01-03,1,1,1,n/a,10,100\n"
        + "2024-01-02,1,1,1,1.7,10,100\nwrong,1,1,1,2,10,100\n2024-01-04,1,1,1,1.9,,\n"
    )
    (bars / "510300.csv").write_text(HEADER + "2025-01-02,1,1,1,4.0,10,100\n")
    (bars / "999999.csv").write_text(HEADER)
    (root / "catalog.csv").write_text(
        "symbol,name\n1,银华货币\n510300,沪深300ETF\n777777,\n510300,again\n"
    )
    return root


def test_bar_files_to_tables(spark, folder, tmp_path):
    built = build_bars_from_files(
        spark, str(folder / "history"), str(folder / "catalog.csv"), str(tmp_path)
    )
    rows = {(r.symbol, r.date): r.close for r in built.bars.collect()}
    assert rows == {
        ("000001", D(2024, 1, 2)): 1.7,
        ("000001", D(2024, 1, 4)): 1.9,
        ("510300", D(2025, 1, 2)): 4.0,
    }
    assert (tmp_path / "bars" / "year=2024").is_dir()
    quality = {r.symbol: r for r in built.quality.collect()}
    assert quality["000001"].rows_raw == 5 and quality["000001"].asset_class == "cash"
    assert quality["999999"].rows_raw == 0 and quality["999999"].name == "999999"
    report = files.read_quality(spark, str(tmp_path / "quality"))
    assert report.count() == 3
    again = files.read_quality_report(spark, str(tmp_path / "quality_report"))
    assert again.exceptAll(report).count() == report.exceptAll(again).count() == 0
    assert spark.read.json(str(tmp_path / "quality_summary")).first().catalog_count == 3


def test_coverage_of_a_folder(spark, folder, tmp_path):
    run = coverage_from_files(
        spark, str(folder / "history"), str(folder / "catalog.csv"), str(tmp_path)
    )
    rows = {r.symbol: (r.name, r.rows, r.status) for r in run.report.collect()}
    assert rows == {
        "000001": ("银华货币", 5, "ok"),
        "510300": ("沪深300ETF", 1, "ok"),
        "777777": ("", 0, "failed"),
    }
    assert spark.read.option("header", True).csv(str(tmp_path / "failed")).count() == 1


def test_each_file_has_a_header_of_its_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "2024-01-02,1,1,1,1.5,10,100\n" * 3)
    (tmp_path / "b.csv").write_text("\ufeffdate,close,open,note\n\n2024-01-02,1,2,\"x, y\"\n2024-01-03,,\n")
    nested = tmp_path / "symbol=000009"
    nested.mkdir()
    (nested / "part-0.csv").write_text("close,date\n7,2024-01-02\n")
    (nested / "part-1.csv").write_text("date,amount\n2024-01-03,5\n")
    rows = files.read_bar_files(spark, str(tmp_path)).collect()
    got = sorted((r.symbol, r.date.day, r.close or 0, r.open or 0, r.amount or 0) for r in rows)
    assert got == [
        ("000009", 2, 7.0, 0, 0),
        ("000009", 3, 0, 0, 5.0),
        *[("a", 2, 1.5, 1.0, 100.0)] * 3,
        ("b", 2, 1.0, 2.0, 0),
        ("b", 3, 0, 0, 0),
    ]
    sizes = {r.symbol: r.bytes for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert set(sizes) == {"000009", "a", "b"}
    (tmp_path / "c.csv").write_text("day,close\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="missing column date"):
        files.read_bar_files(spark, str(tmp_path))


def test_every_layout_is_one_scan_of_the_columns_in_use(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"a{k}.csv").write_text("close,date,volume,note\n" + f"{k},2024-01-02,1,x\n" * 50)
    for k in range(20):
        (tmp_path / f"b{k}.csv").write_text("date,amount,close\n" + f"2024-01-02,7,{k}\n" * 50)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".part.crc").write_text("x")
    bars = files.read_bar_files(spark, str(tmp_path))
    plan = bars.select("symbol", "close")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "Exchange" not in plan
    assert "ReadSchema: struct<c0:string>" in plan and "ReadSchema: struct<c2:string>" in plan
    rows = bars.groupBy("symbol").agg(F.count("close").alias("n"), F.max("close").alias("c"), F.max("amount").alias("m"))
    got = {r.symbol: (r.n, r.c, r.m) for r in rows.collect()}
    assert got == {f"a{k}": (50, float(k), None) for k in range(30)} | {f"b{k}": (50, float(k), 7.0) for k in range(20)}


def test_headers_of_many_small_files_take_few_tasks(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"symbol={k}").mkdir()
        (tmp_path / f"symbol={k}" / "part.csv").write_text(f"date,close\n2024-01-02,{k}\n")
    (tmp_path / "large.csv").write_text("close,date\n" + "7,2024-01-02\n" * 20)
    asked, by_driver = [], files._first_lines_of
    monkeypatch.setattr(files, "WHOLE_BYTES", 100)
    monkeypatch.setattr(files, "_first_lines_of", lambda s, found, n: asked.extend(found) or by_driver(s, found, n))
    context, before = spark.sparkContext, spark.conf.get(files.LISTING_TASKS)
    context.setJobGroup("headers", "headers")
    try:
        rows = files.read_bar_files(spark, str(tmp_path)).groupBy("symbol").agg(F.max("close").alias("c")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.symbol: r.c for r in rows} == {str(k): float(k) for k in range(300)} | {"large": 7.0}
    assert [file.rsplit("/", 1)[1] for file in asked] == ["large.csv"]
    tracker = context.statusTracker()
    stages = [k for job in tracker.getJobIdsForGroup("headers") for k in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(k).numTasks for k in stages) < 200
    assert spark.conf.get(files.LISTING_TASKS) == before


def test_first_lines_are_the_same_whoever_reads_them(spark, tmp_path, monkeypatch):
    lines = {
        "a b+%41[x].csv": "\n \t\n\x1f\n date,close \n2024-01-02,1\n",
        "bom.csv": "\ufeffdate,close\r\n2024-01-02,1\r\n",
        "old.csv": "\r\rclose,date\r1,2024-01-02",
        "wide.csv": "\u3000\ndate\n",
        "blank.csv": "\n" * 50 + " " * 20_000,
        "none.csv": "",
    }
    for name, text in lines.items():
        (tmp_path / name).write_text(text, newline="")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as out:
        out.write("\n\ndate,close\n2024-01-02,3\n")
    whole = files.first_lines(spark, str(tmp_path))
    monkeypatch.setattr(files, "WHOLE_BYTES", -1)
    assert files.first_lines(spark, str(tmp_path)) == whole
    assert {file.rsplit("/", 1)[1]: line for file, line in whole} == {
        "a b+%41[x].csv": " date,close ", "bom.csv": "\ufeffdate,close", "old.csv": "close,date", "wide.csv": "\u3000",
        "c.csv.gz": "date,close",
    }


def test_a_folder_without_rows_has_no_bars(spark, tmp_path):
    assert files.read_bar_files(spark, str(tmp_path)).isEmpty()
    (tmp_path / "a.csv").write_text("\n \n")
    (tmp_path / "b.csv").write_text("date,close\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as out:
        out.write("\n\ndate,close\n2024-01-02,3\n")
    assert [(r.symbol, r.close) for r in files.read_bar_files(spark, str(tmp_path)).collect()] == [("c.csv", 3.0)]


def test_row_order_grows_over_the_splits_of_a_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n\n" + "".join(f"{k}\n" for k in range(60_000)))
    for k in range(40):
        (tmp_path / f"small{k:02d}.csv").write_text("n\n" + "1\n2\n3\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = spark.read.text(str(tmp_path)).select(
            "value", F.col("_metadata.file_name").alias("file"), files.file_order().alias("seq")
        )
        assert lines.rdd.getNumPartitions() > 10
        rows = lines.where("file = 'big.csv' AND value <> 'n'").orderBy("seq").collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert [int(r.value) for r in rows] == list(range(60_000))
    assert len({r.seq for r in rows}) == 60_000


def test_optional_columns_may_be_absent(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,close\n2024-01-02,1.5\n")
    row = files.read_bar_files(spark, str(tmp_path)).first()
    assert (row.symbol, row.close, row.amount) == ("a", 1.5, None)


def test_factor_and_adjusted_files(spark, tmp_path):
    factors, adjusted = tmp_path / "factors", tmp_path / "adjusted"
    factors.mkdir()
    adjusted.mkdir()
    (factors / "510300.csv").write_text("date,f,s,u\n1900-01-01,1,1,0\n2024-01-02,1.1,1,0.5\n")
    (adjusted / "510300.csv").write_text(
        "date,close,total_return_proxy,cumulative_dividend,split_factor\n2024-01-02,1,1.5,0.5,1\n"
    )
    rows = files.read_factor_files(spark, str(factors)).collect()
    assert [(r.symbol, r.date, r.u) for r in rows] == [("510300", D(2024, 1, 2), 0.5)]
    bars = spark.createDataFrame(
        [("510300", D(2024, 1, 2), 1.0, 9.0), ("510300", D(2024, 1, 3), 1.0, 8.0)],
        "symbol string, date date, close double, amount double",
    )
    prices = tables.scan_research(
        bars, files.read_adjusted_files(spark, str(adjusted)), "total-return", ["510300"]
    )
    assert [(r.close, r.amount) for r in prices.collect()] == [(1.5, 9.0)]
    with pytest.raises(ValueError):
        tables.scan_research(bars, price_mode="other")


def test_wide_prices_round_trip(spark, tmp_path):
    source = tmp_path / "wide.csv"
    source.write_text(
        "day,A,B\n2024-01-03,3,\n2024-01-02,1,2\n2024-01-03,,5\n2024-01-04,,\nbad,1,1\n"
    )
    prices = wide.read_wide_prices(spark, str(source))
    # The last row of a repeated date replaces the whole row, empty cells included.
    assert sorted((r.date.day, r.symbol, r.close) for r in prices.collect() if r.close) == [
        (2, "A", 1.0),
        (2, "B", 2.0),
        (3, "B", 5.0),
    ]
    assert {r.date.day for r in prices.collect()} == {2, 3}
    out = tmp_path / "out"
    wide.write_wide_prices(prices, ["A", "B"], str(out))
    again = wide.read_wide_prices(spark, str(out))
    assert again.exceptAll(prices).count() == prices.exceptAll(again).count() == 0


def test_single_series_combine_to_one_table(spark):
    rows = [("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 3), 2.0), ("b", D(2024, 1, 3), 5.0), ("c", D(2024, 1, 3), 9.0)]
    series = spark.createDataFrame(rows, "source string, date date, nav double")
    combined = wide.combine_series(series, {"a": "A", "b": "B"}, "source", "nav")
    assert combined.columns == ["date", "symbol", "close"]
    wide_rows = wide.pivot_prices(combined, ["A", "B"])
    assert [tuple(r) for r in wide_rows.orderBy("date").collect()] == [
        (D(2024, 1, 2), 1.0, None),
        (D(2024, 1, 3), 2.0, 5.0),
    ]


def test_many_series_are_one_scan(spark, tmp_path):
    def plan(count):
        folder = tmp_path / str(count)
        folder.mkdir()
        for k in range(count):
            (folder / f"s[{k}].csv").write_text(f"date,close\n2024-01-02,{k}\n2024-01-03,{k + 1}\n2024-01-02,7\n,1\n")
        assets = {f"s[{k}]": f"asset {k}" for k in range(count)}
        combined = wide.combine_series(files.read_series_files(spark, str(folder)), assets)
        text = combined._jdf.queryExecution().optimizedPlan().toString()
        return combined, text

    few, small = plan(10)
    many, large = plan(1500)
    assert small.count("\n") == large.count("\n") and large.count("Relation [") == 1
    for frame, count in ((few, 10), (many, 1500)):
        got = {(r.symbol, r.date.day): r.close for r in frame.collect()}
        assert got == {(f"asset {k}", day): float(k + day - 2) for k in range(count) for day in (2, 3)}


def test_universe_config(spark, tmp_path):
    good = tmp_path / "u.csv"
    good.write_text(
        "asset,signal_symbol,signal_name,implementation_fund,defensive\nX,000001,x,,0\nY,2,y,,1\n"
    )
    rows = files.read_universe(spark, str(good)).orderBy("asset").collect()
    assert [(r.signal_symbol, r.implementation_fund, r.defensive) for r in rows] == [
        ("000001", "", 0),
        ("2", "", 1),
    ]
    bad = tmp_path / "bad.csv"
    bad.write_text("asset,signal_symbol,signal_name,defensive\nX,1,x,0\nX,2,y,1\n")
    with pytest.raises(ValueError, match="unique"):
        files.read_universe(spark, str(bad))
    bad.write_text("asset,signal_symbol\nX,1\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_universe(spark, str(bad))


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.range(10).selectExpr(
        "string(id) AS symbol", "date_add(DATE'2024-01-01', int(id)) AS date",
        "double(id) AS open", "double(id) AS close", "double(id) AS amount",
    ).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    frame = tables.scan_prices(spark.read.parquet(path), ["1", "2"], "2024-01-02", "2024-01-02")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "In(symbol" in plan
    assert "ReadSchema: struct<symbol:string,date:date,close:double>" in plan
    assert [r.symbol for r in frame.collect()] == ["1"]


def test_windows_over_bucketed_bars_need_no_shuffle(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "string(id % 7) AS symbol", "date_add(DATE'2024-01-01', int(id div 7)) AS date", "double(id) + 1 AS close"
    )
    sinks.write_bucketed(rows, "bucketed_prices", 4, str(tmp_path / "bars"))
    text = volatility_of(spark.table("bucketed_prices"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Bucketed: true" in text
    spark.sql("DROP TABLE bucketed_prices")


def test_adjusted_table_refuses_repeated_keys(spark, tmp_path):
    bars = spark.createDataFrame(
        [("A", D(2024, 1, 2), 1.0, 1.0), ("A", D(2024, 1, 2), 2.0, 1.0)], "symbol string, date date, close double, amount double"
    )
    bars.write.parquet(str(tmp_path / "bars"))
    (tmp_path / "factors").mkdir()
    (tmp_path / "factors" / "A.csv").write_text("date,f,s,u\n2024-01-01,1,1,0\n")
    with pytest.raises(ValueError, match="duplicate symbol, date"):
        build_total_return_from_files(spark, str(tmp_path / "bars"), str(tmp_path / "factors"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_bucketed_table_needs_no_shuffle(spark):
    rows = spark.range(100).selectExpr(
        "string(id % 7) AS symbol", "date_add(DATE'2024-01-01', int(id)) AS date", "id AS close"
    )
    sinks.write_bucketed(rows, "bucketed_bars", 4)
    ranked = spark.table("bucketed_bars").withColumn(
        "n", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    )
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 100
    spark.sql("DROP TABLE bucketed_bars")
