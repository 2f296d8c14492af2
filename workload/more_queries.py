"""Queries on round trips through files, on keys and ties, and on the remaining small operators.

Files are written below the shared scratch folder and read back by the library's own readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.classify import asset_class
from panelwright.operators import rolling
from panelwright.operators.asof import asof_backward
from panelwright.operators.calendar import slot_calendar
from panelwright.operators.cleaning import keep_last
from panelwright.operators.panel import attach_slots, duplicate_keys
from panelwright.plans import quality as quality_plan
from panelwright.plans import research, rotation
from panelwright.plans.adjustment import adjusted_prices, build_total_return, build_total_return_from_files
from panelwright.scratch import pin, scratch_root
from panelwright.sources import files, sinks, wide
from panelwright.sources.normalize import normalize_series
from panelwright.sources.tables import scan_research
from workload import adapters, settings
from workload.adapters import fixed
from workload.queries import QUALITY_DOUBLES, SUMMARY_DOUBLES, _fixed_columns, _quality, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query
def duplicate_bars(spark, sf_dir):
    return duplicate_keys(adapters.raw_lines(spark, sf_dir).where("date IS NOT NULL"))


def _tied_events(spark, sf_dir, **options) -> DataFrame:
    """Purchases and signups with repeated times, missing times and missing users."""
    events = adapters.table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 11 != 0, F.date_trunc("day", "ts")).alias("ts"),
        "event_id",
        "event_type",
        "value",
    )
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    signups = events.where("event_type <> 'purchase'").select(
        "user_id", "ts", F.col("event_id").alias("other_id"), F.col("value").alias("other_value")
    )
    joined = asof_backward(
        purchases, signups, "user_id", "ts", ["other_id", "other_value"], order="other_id", **options
    )
    return _fixed_columns(joined.drop("ts"), "other_value")


@query
def asof_ties(spark, sf_dir):
    return _tied_events(spark, sf_dir)


@query
def asof_ties_hot(spark, sf_dir):
    return _tied_events(
        spark, sf_dir, bucket=F.date_trunc("week", "ts"), hot_key_rows=settings.HOT_USER_ROWS
    )


@query
def bars_from_files(spark, sf_dir):
    """Raw lines as CSV in two layouts, one folder per symbol, read back and cleaned."""
    path = _folder(spark, "bars")
    lines = adapters.raw_lines(spark, sf_dir)
    even = F.substring("symbol", -1, 1).isin("0", "2", "4", "6", "8")
    ordered = lines.repartition("symbol").sortWithinPartitions("symbol", "ingest_seq")
    written = ordered.select(
        "symbol", F.date_format("date", "yyyyMMdd").alias("date"), "close", "volume", "amount", "open", "high", "low"
    )
    for part, layout in (
        (even, ["date", "open", "high", "low", "close", "volume", "amount"]),
        (~even, ["amount", "close", "volume", "date"]),
    ):
        written.where(part).select("symbol", *layout).write.mode("append").partitionBy("symbol").option(
            "header", True
        ).csv(path)
    bars = keep_last(files.read_bar_files(spark, path))
    return _fixed_columns(bars, "close", "volume", "amount").drop("open", "high", "low")


@query
def series_first(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.date_format("o_orderdate", "yyyy/M/d").alias("净值日期"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise("-").alias("单位净值"),
        "o_orderkey",
    )
    series = normalize_series(orders, "o_orderkey", "nav", by=["o_orderpriority"])
    return _fixed_columns(series, "nav")


@query
def factor_guard(spark, sf_dir):
    """Factor files with placeholder dates, written and read back."""
    path = _folder(spark, "factors")
    factors = adapters.type_factors(spark, sf_dir)
    placed = factors.select(
        F.translate("symbol", " ", "_").alias("symbol"),
        F.when(F.month("date") == 6, F.lit("1900-01-01").cast("date")).otherwise(F.col("date")).alias("date"),
        "f", "s", "u",
    )
    placed.write.partitionBy("symbol").option("header", True).csv(path)
    return _fixed_columns(files.read_factor_files(spark, path).drop("ingest_seq"), "f", "s", "u")


@query
def adjusted_join(spark, sf_dir):
    """Adjusted prices stored without an amount, which then comes from the bars."""
    bars = adapters.type_bars(spark, sf_dir)
    adjusted = pin(adjusted_prices(bars, adapters.type_factors(spark, sf_dir)), "adjusted")
    prices = scan_research(bars, adjusted, "total-return", None, "1996-01-01", "1998-12-31")
    return _fixed_columns(prices, "close", "amount")


@query
def combined_series(spark, sf_dir):
    """One file folder per series, named in lower case, combined under the assets' own names."""
    path = _folder(spark, "series")
    bars = pin(adapters.type_bars(spark, sf_dir).select("symbol", "date", "close"), "bars")
    key = F.lower("symbol")
    bars.select(key.alias("symbol"), "date", "close").repartition("symbol").write.partitionBy("symbol").option(
        "header", True
    ).csv(path)
    assets = bars.select(key.alias("key"), "symbol").distinct()
    return _fixed_columns(wide.combine_series(files.read_series_files(spark, path), assets), "close")


@query
def universe_config(spark, sf_dir):
    """Part types as a universe file, written, read back and validated."""
    path = _folder(spark, "universe")
    types = adapters.table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("parts"))
    types.select(
        F.col("p_type").alias("asset"),
        F.upper("p_type").alias("signal_symbol"),
        F.when(F.col("p_type") != settings.DEFENSIVE, F.lower("p_type")).alias("signal_name"),
        (F.col("p_type") == settings.DEFENSIVE).cast("int").alias("defensive"),
    ).write.option("header", True).csv(path)
    return files.read_universe(spark, path)


@query
def wide_round_trip(spark, sf_dir):
    path = _folder(spark, "wide")
    bars = pin(adapters.type_bars(spark, sf_dir).select("symbol", "date", "close"), "bars")
    names = sorted(row.symbol for row in bars.select("symbol").distinct().collect())
    wide.write_wide_prices(bars, names, path)
    return _fixed_columns(wide.read_wide_prices(spark, path).where("close IS NOT NULL"), "close")


@query
def catalog_round_trip(spark, sf_dir):
    """A catalog in several files, whose sequence column tells first rows from repeated ones."""
    path = _folder(spark, "catalog")
    customers = adapters.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("symbol"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"),
        F.col("c_custkey").alias("seq"),
    )
    again = customers.where("seq % 10 = 3").select("symbol", F.lit("again").alias("name"), (F.col("seq") + 5).alias("seq"))
    rows = customers.unionByName(again).repartitionByRange("seq")
    rows.write.option("header", True).csv(path)
    return files.read_catalog(spark, path, "seq")


@query
def quality_round_trip(spark, sf_dir):
    path = _folder(spark, "quality")
    quality = pin(_quality(spark, sf_dir), "quality")
    sinks.write_report(quality, path, "symbol")
    return _fixed_columns(files.read_quality_report(spark, path), *QUALITY_DOUBLES)


@query
def bars_by_year(spark, sf_dir):
    path = _folder(spark, "by-year")
    sinks.write_by_year(adapters.type_bars(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("year", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), fixed(F.max("close")).alias("top_close")
    )


@query
def research_universe_totals(spark, sf_dir):
    quality = pin(_quality(spark, sf_dir), "quality")
    pool = pin(quality_plan.research_universe(quality, **settings.RESEARCH_POOL), "pool")
    totals = quality_plan.research_totals(quality, pool)
    entries = F.transform(
        F.sort_array(F.map_entries("selected_by_asset_class")),
        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")),
    )
    return totals.select("as_of", "selected", F.array_join(entries, ";").alias("classes"))


@query
def total_return_build(spark, sf_dir):
    """Types of which one has an empty factor source and one has none."""
    bars = adapters.type_bars(spark, sf_dir)
    factors = adapters.type_factors(spark, sf_dir).where("symbol NOT IN ('ECONOMY', 'LARGE')")
    inventory = bars.select("symbol").where("symbol <> 'LARGE'").distinct()
    result = build_total_return(bars, factors, inventory)
    done = result.adjusted.groupBy("symbol").agg(
        F.lit("done").alias("status"),
        F.count(F.lit(1)).alias("rows"),
        fixed(F.max("total_return_proxy")).alias("top_price"),
    )
    failed = result.missing.select(
        "symbol", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("rows"),
        F.lit(None).cast("double").alias("top_price"),
    )
    return done.unionByName(failed)


@query
def classify_names(spark, sf_dir):
    """Brands renamed after the default rules' own keywords, so that every rule is hit."""
    parts = adapters.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    words = F.array(*[F.lit(word) for word in settings.CLASS_WORDS])
    name = F.concat(
        F.get(words, F.col("p_partkey") % len(settings.CLASS_WORDS)),
        F.col("p_brand"),
        F.when(F.col("p_partkey") % 3 == 0, F.get(words, F.floor(F.col("p_partkey") / 3) % len(settings.CLASS_WORDS)))
        .otherwise(""),
    )
    return parts.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("parts")).select(
        "name", asset_class(F.col("name")).alias("asset_class"), "parts"
    )


@query
def rotation_files(spark, sf_dir):
    """The rotation's daily series as its report writes it, read back."""
    path = _folder(spark, "rotation")
    bars = pin(adapters.type_bars(spark, sf_dir).select("symbol", "date", "close"), "bars")
    rotation.rotation_report(bars, settings.DEFENSIVE, path, settings.ROTATION)
    kinds = {"date": "date", "gross_return": "double", "turnover": "double", "cost": "double", "net_return": "double", "nav": "double"}
    stored = spark.read.option("header", True).csv(f"{path}/daily")
    typed = stored.select("scenario_id", *[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])
    return _fixed_columns(typed, *list(kinds)[1:])


def _by_symbol(rows: DataFrame, path: str) -> None:
    rows.repartition("symbol").write.mode("append").partitionBy("symbol").option("header", True).csv(path)


ADJUSTED_DOUBLES = ("close", "total_return_proxy", "cumulative_dividend", "split_factor")


@query
def adjusted_files(spark, sf_dir):
    """Adjusted bars as one folder of CSV per symbol, one of them without rows, read back."""
    path = _folder(spark, "adjusted")
    adjusted = adjusted_prices(adapters.type_bars(spark, sf_dir), adapters.type_factors(spark, sf_dir))
    _by_symbol(adjusted, path)
    adjusted.drop("symbol").limit(0).write.option("header", True).csv(f"{path}/symbol=EMPTY")
    return _fixed_columns(files.read_adjusted_files(spark, path), *ADJUSTED_DOUBLES)


@query
def total_return_table(spark, sf_dir):
    """The stored adjusted table, from stored bars and factor files, scanned by price mode.

    One type has a factor file without rows and one has none.
    """
    path = _folder(spark, "total-return")
    sinks.write_by_year(adapters.type_bars(spark, sf_dir), f"{path}/bars")
    factors = adapters.type_factors(spark, sf_dir).where("symbol <> 'LARGE'")
    _by_symbol(factors.where("symbol <> 'ECONOMY'"), f"{path}/factors")
    factors.drop("symbol").limit(0).write.option("header", True).csv(f"{path}/factors/symbol=ECONOMY")
    build_total_return_from_files(spark, f"{path}/bars", f"{path}/factors", path)
    prices = scan_research(spark.read.parquet(f"{path}/bars"), spark.read.parquet(f"{path}/adjusted"), "total-return")
    missing = spark.read.option("header", True).csv(f"{path}/missing_factors")
    rows = prices.select("symbol", "date", fixed("close").alias("price"), fixed("amount").alias("amount"))
    return rows.unionByName(missing.select("symbol"), allowMissingColumns=True)


def _report_rank(report: DataFrame, *groups: str) -> DataFrame:
    """Rows of a report in several files with their place in their group, by file and place in it."""
    placed = report.select("*", F.col("_metadata.file_name").alias("file"), files.file_order().alias("place"))
    by = Window.partitionBy(*groups).orderBy("file", "place")
    return placed.withColumn("rank", F.row_number().over(by)).drop("file", "place")


def _stored_quality(spark, sf_dir) -> str:
    path = _folder(spark, "quality")
    sinks.write_table(_quality(spark, sf_dir), f"{path}/quality")
    return path


@query
def snapshot_report(spark, sf_dir):
    """The snapshot's report from stored quality, read back in its own order."""
    path = _stored_quality(spark, sf_dir)
    quality_plan.build_snapshot(spark, f"{path}/quality", path, **settings.SNAPSHOT)
    report = spark.read.option("header", True).csv(f"{path}/snapshot")
    return _report_rank(report, "eligible", "asset_class").select(
        "symbol",
        "asset_class",
        F.col("eligible").cast("boolean").alias("eligible"),
        F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"),
        F.col("stale_days").cast("int").alias("stale_days"),
        fixed(F.col("median_amount_60d").cast("double")).alias("median_amount_60d"),
        "rank",
    )


@query
def research_pool_report(spark, sf_dir):
    """The research pool's report from stored quality, read back in its own order, with its totals."""
    path = _stored_quality(spark, sf_dir)
    quality_plan.build_research_universe(spark, f"{path}/quality", path, **settings.RESEARCH_POOL)
    report = spark.read.option("header", True).csv(f"{path}/research_universe")
    totals = spark.read.schema("as_of date, selected long").json(f"{path}/research_totals")
    totals = {name: totals.select(name).scalar() for name in ("as_of", "selected")}
    return _report_rank(report, "asset_class").withColumns(totals).select(
        "symbol",
        "name",
        "asset_class",
        F.col("rows_valid").cast("long").alias("rows_valid"),
        F.col("last_date").cast("date").alias("last_date"),
        fixed(F.col("median_amount_60d").cast("double")).alias("median_amount_60d"),
        "rank",
        "as_of",
        "selected",
    )


def _research_files(spark, sf_dir) -> str:
    path = _folder(spark, "research")
    bars = pin(adapters.brand_sessions(spark, sf_dir), "bars")
    research.research_report(
        bars, adapters.brand_classes(spark, sf_dir), settings.SCENARIOS, path, spec=settings.SPEC
    )
    return path


@query
def research_report_orders(spark, sf_dir):
    """Orders of the research report as written, read back."""
    stored = spark.read.option("header", True).csv(f"{_research_files(spark, sf_dir)}/orders")
    return stored.select(
        "scenario_id",
        F.col("signal_date").cast("date").alias("signal_date"),
        F.col("execution_date").cast("date").alias("execution_date"),
        F.coalesce("selected", F.lit("")).alias("selected"),
        F.col("selected_count").cast("int").alias("selected_count"),
    )


@query
def research_report_summary(spark, sf_dir):
    """Summaries of the research report as JSON, read back, with two of the recorded parameters."""
    kinds = "scenario_id string, price_mode string, start date, end date, rebalance_count long"
    doubles = ", ".join(f"{name} double" for name in SUMMARY_DOUBLES)
    schema = f"{kinds}, {doubles}, parameters map<string,string>"
    stored = spark.read.schema(schema).json(f"{_research_files(spark, sf_dir)}/summary")
    parameters = [
        F.col("parameters")[name].cast(kind).alias(name) for name, kind in (("top_n", "int"), ("cost_bps", "double"))
    ]
    return _fixed_columns(stored.select("*", *parameters).drop("parameters"), *SUMMARY_DOUBLES)


@query
def bucketed_volatility(spark, sf_dir):
    """Rolling volatility on bars stored in buckets by symbol, whose windows need no shuffle."""
    name = f"bars_{uuid.uuid4().hex}"
    bars = adapters.type_bars(spark, sf_dir).select("symbol", "date", "close")
    sinks.write_bucketed(bars, name, settings.BUCKETS, f"{_folder(spark, 'buckets')}/bars")
    return _fixed_columns(volatility_of(spark.table(name)), "vol_5", "vol_20")


def volatility_of(bars: DataFrame) -> DataFrame:
    slotted = attach_slots(bars, pin(slot_calendar(bars), "calendar"))
    returns = slotted.select("symbol", "date", "pos", rolling.simple_return(F.col("close")).alias("ret"))
    return returns.select("symbol", "date", *[rolling.volatility(F.col("ret"), n).alias(f"vol_{n}") for n in (5, 20)])
