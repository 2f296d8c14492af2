"""One Spark query per operator and job, over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.classify import asset_class
from panelwright.functions.folds import capped_inverse_vol
from panelwright.functions.numbers import to_day, to_number
from panelwright.operators import coverage, cross_section, performance, rolling
from panelwright.operators.asof import asof_backward
from panelwright.operators.calendar import rebalance_dates, slot_calendar
from panelwright.operators.cleaning import keep_last
from panelwright.operators.panel import attach_slots, densify
from panelwright.operators.selection import top_n, top_n_per_category
from panelwright.plans import quality as quality_plan
from panelwright.plans import research, rotation
from panelwright.plans.adjustment import adjusted_prices
from panelwright.plans.ingest import ingest_coverage
from panelwright.scratch import pin
from panelwright.sources.normalize import normalize_bars
from panelwright.sources.tables import restrict, scan_research
from panelwright.sources.wide import pivot_prices, unpivot_prices
from workload import adapters, settings
from workload.adapters import fixed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _fixed_columns(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: fixed(name) for name in names})


# Ingest and quality


@query
def bars_rollup(spark, sf_dir):
    bars = adapters.type_bars(spark, sf_dir)
    return _fixed_columns(bars, "high", "low", "close", "volume", "amount")


@query
def bars_dedupe_last(spark, sf_dir):
    bars = keep_last(adapters.raw_lines(spark, sf_dir))
    return _fixed_columns(bars, "close", "volume", "amount").drop("open", "high", "low")


@query
def bars_dedupe_first(spark, sf_dir):
    raw = adapters.raw_lines(spark, sf_dir).select(
        "symbol",
        F.col("date").alias("日期"),
        F.col("close").alias("收盘"),
        F.col("volume").alias("成交量"),
        F.col("amount").alias("成交额"),
        "ingest_seq",
    )
    bars = normalize_bars(raw, "lines", order="ingest_seq", by=["symbol"])
    return _fixed_columns(bars, "close", "volume", "amount").drop("open", "high", "low")


@query
def bars_missing_cast(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    text = adapters.table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), iso))
        .when(F.col("o_orderstatus") == "F", compact)
        .otherwise(iso)
        .alias("day_text"),
        F.when(
            F.col("o_orderpriority").startswith("5"), F.concat(F.col("o_totalprice"), F.lit(" CNY"))
        )
        .when(F.col("o_orderpriority").startswith("3"), F.lit("nan"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("price_text"),
    )
    typed = text.select(
        "o_orderpriority",
        to_day(F.col("day_text")).alias("day"),
        to_number(F.col("price_text")).alias("price"),
    )
    return typed.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("day").alias("days"),
        F.count("price").alias("prices"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        fixed(F.max("price")).alias("top_price"),
    )


@query
def range_filter(spark, sf_dir):
    bars = keep_last(adapters.raw_lines(spark, sf_dir))
    pool = adapters.supplier_catalog(spark, sf_dir)
    rows = restrict(bars, pool, "1996-02-01", "1999-06-30")
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def _quality(spark, sf_dir) -> DataFrame:
    built = quality_plan.build_bars(
        adapters.raw_lines(spark, sf_dir),
        adapters.supplier_catalog(spark, sf_dir),
        adapters.supplier_inventory(spark, sf_dir),
        settings.REGION_RULES,
        settings.DEFAULT_CLASS,
    )
    return built.quality


QUALITY_DOUBLES = ("median_amount_60d", "zero_volume_ratio_60d")


@query
def quality_audit(spark, sf_dir):
    return _fixed_columns(_quality(spark, sf_dir), *QUALITY_DOUBLES)


@query
def quality_summary(spark, sf_dir):
    catalog = adapters.supplier_catalog(spark, sf_dir)
    totals = quality_plan.quality_summary(pin(_quality(spark, sf_dir), "quality"), catalog)
    doubles = ("median_history_rows", "amount_q25", "amount_q50", "amount_q75")
    return _fixed_columns(totals, *doubles).select(
        "*", F.array_join(
            F.transform(
                F.sort_array(F.map_entries("asset_class_counts")),
                lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")),
            ),
            ";",
        ).alias("classes"),
    ).drop("asset_class_counts")


@query
def quality_by_class(spark, sf_dir):
    return quality_plan.counts_by_class(_quality(spark, sf_dir))


@query
def classify_rules(spark, sf_dir):
    parts = adapters.table(spark, sf_dir, "part")
    label = asset_class(F.col("p_name"), settings.PART_RULES, settings.DEFAULT_CLASS)
    return parts.groupBy("p_name", label.alias("asset_class")).agg(
        F.count(F.lit(1)).alias("parts")
    )


@query
def classify_documents(spark, sf_dir):
    documents = adapters.table(spark, sf_dir, "documents")
    return documents.groupBy("lang", asset_class(F.col("text")).alias("asset_class")).agg(
        F.count(F.lit(1)).alias("documents")
    )


def _snapshot(spark, sf_dir) -> DataFrame:
    return quality_plan.universe_snapshot(
        pin(_quality(spark, sf_dir), "quality"), **settings.SNAPSHOT
    )


@query
def universe_snapshot(spark, sf_dir):
    report = quality_plan.export_snapshot(_snapshot(spark, sf_dir))
    return _fixed_columns(report, *QUALITY_DOUBLES)


@query
def universe_by_class(spark, sf_dir):
    return quality_plan.counts_by_class(_snapshot(spark, sf_dir).where("eligible"))


@query
def universe_totals(spark, sf_dir):
    totals = quality_plan.snapshot_totals(pin(_snapshot(spark, sf_dir), "snapshot"))
    return totals.drop("eligible_by_asset_class")


@query
def research_universe(spark, sf_dir):
    pool = quality_plan.research_universe(
        pin(_quality(spark, sf_dir), "quality"), **settings.RESEARCH_POOL
    )
    report = quality_plan.export_research_universe(pool)
    return _fixed_columns(report, "median_amount_60d")


@query
def ingest_status(spark, sf_dir):
    return ingest_coverage(
        adapters.customer_catalog(spark, sf_dir),
        adapters.order_inventory(spark, sf_dir),
        adapters.fetch_results(spark, sf_dir),
    ).report


@query
def ingest_totals(spark, sf_dir):
    return ingest_coverage(
        adapters.customer_catalog(spark, sf_dir), adapters.order_inventory(spark, sf_dir)
    ).totals


@query
def pending_anti(spark, sf_dir):
    return coverage.pending(
        adapters.customer_catalog(spark, sf_dir), adapters.order_inventory(spark, sf_dir)
    )


# As-of joins


@query
def asof_adjust(spark, sf_dir):
    adjusted = adjusted_prices(
        adapters.type_bars(spark, sf_dir), adapters.type_factors(spark, sf_dir)
    )
    return _fixed_columns(
        adjusted, "close", "total_return_proxy", "cumulative_dividend", "split_factor"
    )


def _asof_events(spark, sf_dir, bucket: Column | None = None, **options) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select(
        "user_id", "ts", "event_id", "value"
    )
    signups = events.where("event_type = 'signup'").select(
        "user_id", "ts", F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    joined = asof_backward(
        purchases, signups, "user_id", "ts", ["signup_id", "signup_value"], bucket, **options
    )
    return _fixed_columns(joined.drop("ts"), "value", "signup_value")


@query
def asof_events(spark, sf_dir):
    return _asof_events(spark, sf_dir, F.date_trunc("minute", "ts"))


@query
def asof_events_hot(spark, sf_dir):
    return _asof_events(
        spark, sf_dir, F.date_trunc("day", "ts"), hot_key_rows=settings.HOT_USER_ROWS
    )


# Panel shape


@query
def panel_dense(spark, sf_dir):
    dense = _dense(adapters.brand_bars(spark, sf_dir), "close", "amount")
    return _fixed_columns(dense, "close", "amount")


@query
def panel_wide_pivot(spark, sf_dir):
    symbols = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    wide = pivot_prices(adapters.type_bars(spark, sf_dir), symbols)
    return _fixed_columns(wide, *symbols)


@query
def panel_unpivot(spark, sf_dir):
    lines = adapters.table(spark, sf_dir, "lineitem")
    flags = ["A", "N", "R"]
    wide = lines.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        *[
            F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))).alias(flag)
            for flag in flags
        ]
    )
    return _fixed_columns(unpivot_prices(wide, flags), "close")


# Rolling measures


def _with_slots(bars: DataFrame) -> DataFrame:
    bars = pin(bars, "bars")
    return attach_slots(bars, slot_calendar(bars))


def _dense(bars: DataFrame, *values: str) -> DataFrame:
    bars = pin(bars, "bars")
    return densify(bars, pin(slot_calendar(bars), "calendar"), values)


@query
def returns_1(spark, sf_dir):
    bars = _with_slots(adapters.brand_bars(spark, sf_dir))
    return bars.select(
        "symbol", "date", fixed(rolling.simple_return(F.col("close"))).alias("ret")
    )


@query
def momentum_k(spark, sf_dir):
    bars = _with_slots(adapters.brand_bars(spark, sf_dir))
    return bars.select(
        "symbol",
        "date",
        *[
            fixed(rolling.simple_return(F.col("close"), k)).alias(f"momentum_{k}")
            for k in (5, 20, 60)
        ],
    )


@query
def rolling_vol(spark, sf_dir):
    bars = _with_slots(adapters.type_bars(spark, sf_dir))
    returns = bars.select(
        "symbol", "date", "pos", rolling.simple_return(F.col("close")).alias("ret")
    )
    return returns.select(
        "symbol",
        "date",
        *[fixed(rolling.volatility(F.col("ret"), n)).alias(f"vol_{n}") for n in (5, 20)],
    )


@query
def trend_ma(spark, sf_dir):
    bars = _with_slots(adapters.type_bars(spark, sf_dir)).select("symbol", "date", "pos", "close")
    averaged = rolling.with_moving_averages(bars, "close", {"ma_10": 10, "ma_60": 60})
    trend = averaged.withColumn("trend", F.col("close") > F.col("ma_10"))
    return _fixed_columns(trend.drop("pos", "close"), "ma_10", "ma_60")


@query
def rolling_median_amount(spark, sf_dir):
    bars = _with_slots(adapters.type_bars(spark, sf_dir)).select("symbol", "date", "pos", "amount")
    for size in (5, 60):
        bars = rolling.with_moving_median(bars, "amount", f"median_{size}", size)
    return _fixed_columns(bars.drop("pos", "amount"), "median_5", "median_60")


@query
def history_count(spark, sf_dir):
    bars = _with_slots(adapters.brand_bars(spark, sf_dir))
    return bars.select("symbol", "date", rolling.history_count(F.col("close")).alias("history"))


@query
def staleness(spark, sf_dir):
    return _dense(adapters.brand_bars(spark, sf_dir), "close").select(
        "symbol",
        "date",
        rolling.last_seen(F.col("close"), F.col("date")).alias("last_seen"),
        rolling.stale_days(F.col("close"), F.col("date")).alias("stale_days"),
    )


# Cross-section, calendar and selection


def _signals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    bars = pin(adapters.brand_sessions(spark, sf_dir), "bars")
    calendar = pin(slot_calendar(bars), "calendar")
    signals = research.research_signals(
        bars, adapters.brand_classes(spark, sf_dir), calendar, [5, 8], settings.SPEC
    )
    return pin(signals, "signals"), calendar


def _market(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    return pin(research.market_by_date(signals, calendar, [5, 8], settings.SPEC), "market")


@query
def zscore_xs(spark, sf_dir):
    signals, _ = _signals(spark, sf_dir)
    live = signals.where("is_rebalance")
    stats = live.groupBy("pos").agg(*cross_section.moments(["ratio_4"]))
    return live.join(stats, "pos").select(
        "symbol",
        "date",
        fixed("ratio_4").alias("ratio_4"),
        fixed(cross_section.zscore("ratio_4")).alias("zscore"),
    )


@query
def composite_score(spark, sf_dir):
    signals, calendar = _signals(spark, sf_dir)
    scored = research.scored_candidates(
        signals, _market(signals, calendar), [5, 8], settings.SPEC
    )
    return scored.select("symbol", "pos", "trend_window", fixed("score").alias("score"))


@query
def rebalance_calendar(spark, sf_dir):
    calendar = slot_calendar(adapters.type_bars(spark, sf_dir))
    return rebalance_dates(calendar)


@query
def hold_intervals(spark, sf_dir):
    calendar = slot_calendar(adapters.type_bars(spark, sf_dir))
    return calendar.select("date", "pos", "week_end", "active_signal_pos", "active_signal_date")


@query
def breadth(spark, sf_dir):
    signals, calendar = _signals(spark, sf_dir)
    return _market(signals, calendar).select(
        "date", fixed("breadth_5").alias("breadth_5"), fixed("breadth_8").alias("breadth_8")
    )


@query
def defensive_fallback(spark, sf_dir):
    signals, calendar = _signals(spark, sf_dir)
    return _market(signals, calendar).where("is_rebalance").select(
        "date", F.col("fallback.symbol").alias("symbol"), fixed("fallback.vol").alias("vol")
    )


def _scored(spark, sf_dir) -> DataFrame:
    signals, calendar = _signals(spark, sf_dir)
    scored = research.scored_candidates(
        signals, _market(signals, calendar), [5, 8], settings.SPEC
    )
    return scored.where("trend_window = 5")


@query
def topn_plain(spark, sf_dir):
    return top_n(_scored(spark, sf_dir), ["pos"], 3).select("pos", "symbol", "rank")


@query
def topn_category_cap(spark, sf_dir):
    best = top_n_per_category(_scored(spark, sf_dir), ["pos"], 5, 2)
    return best.select("pos", "symbol", "asset_class", "rank")


def _picked(spark, sf_dir) -> DataFrame:
    best = top_n_per_category(_scored(spark, sf_dir), ["pos"], 8, 3)
    return best.groupBy("pos").agg(
        F.sort_array(F.collect_list(F.struct("rank", "symbol", "asset_class", "vol"))).alias("names")
    )


@query
def invvol_raw(spark, sf_dir):
    free = F.lit(1.0)
    weights = capped_inverse_vol(F.col("names"), free, free)
    return _fixed_columns(_picked(spark, sf_dir).select("pos", F.inline(weights)), "weight")


@query
def invvol_capped(spark, sf_dir):
    weights = capped_inverse_vol(F.col("names"), F.lit(0.2), F.lit(0.35))
    return _fixed_columns(_picked(spark, sf_dir).select("pos", F.inline(weights)), "weight")


# Jobs


def _rotation(spark, sf_dir) -> rotation.RotationResult:
    bars = pin(adapters.type_bars(spark, sf_dir), "bars")
    return rotation.run_rotation(bars, settings.DEFENSIVE, settings.ROTATION)


def _research(spark, sf_dir, scenarios=settings.SCENARIOS) -> research.ResearchRun:
    prices = {"raw": pin(adapters.brand_sessions(spark, sf_dir), "bars")}
    return research.run_research(
        prices, adapters.brand_classes(spark, sf_dir), scenarios, settings.SPEC
    )


def _daily(frame: DataFrame) -> DataFrame:
    return _fixed_columns(frame.drop("pos"), *performance.DAILY)


SUMMARY_DOUBLES = (
    "total_return",
    "annualized_return",
    "annualized_volatility",
    "max_drawdown",
    "calmar",
    "average_daily_turnover",
    "total_cost",
)


@query
def rotation_signals(spark, sf_dir):
    bars = pin(adapters.type_bars(spark, sf_dir), "bars")
    signals = rotation.rotation_signals(bars, slot_calendar(bars), settings.ROTATION)
    return signals.select("symbol", "date", "trend", fixed("score").alias("score"))


@query
def rotation_orders(spark, sf_dir):
    orders = _rotation(spark, sf_dir).orders
    return orders.select(
        "signal_date", "execution_date", F.array_join("selected", ",").alias("selected")
    )


@query
def rotation_weights(spark, sf_dir):
    weights = _rotation(spark, sf_dir).weights
    return weights.select("date", "symbol", fixed("weight").alias("weight"))


@query
def rotation_daily(spark, sf_dir):
    return _daily(_rotation(spark, sf_dir).daily)


@query
def rotation_summary(spark, sf_dir):
    return _fixed_columns(_rotation(spark, sf_dir).summary, *SUMMARY_DOUBLES)


@query
def research_orders(spark, sf_dir):
    orders = _research(spark, sf_dir).orders
    return orders.withColumn("selected", F.array_join("selected", ","))


@query
def research_weights(spark, sf_dir):
    weights = _research(spark, sf_dir).weights
    return weights.select("scenario_id", "date", "symbol", fixed("weight").alias("weight"))


def _one_scenario(name: str) -> Query:
    def run(spark, sf_dir):
        chosen = tuple(s for s in settings.SCENARIOS if s.scenario_id == name)
        return _daily(_research(spark, sf_dir, chosen).daily)

    return run


for _query_name, _scenario_id in settings.SINGLE_RUNS.items():
    QUERIES[_query_name] = _one_scenario(_scenario_id)


@query
def scenario_grid(spark, sf_dir):
    return _daily(_research(spark, sf_dir).daily)


@query
def nav_drawdown(spark, sf_dir):
    daily = _research(spark, sf_dir).daily
    return daily.select(
        "scenario_id", "date", fixed(performance.drawdown(F.col("nav"))).alias("drawdown")
    )


@query
def summary_metrics(spark, sf_dir):
    summary = _research(spark, sf_dir).summary.drop("price_mode", "parameters")
    return _fixed_columns(summary, *SUMMARY_DOUBLES)


@query
def total_return_research(spark, sf_dir):
    """The research job on adjusted prices, with the traded amount carried along."""
    bars = adapters.type_bars(spark, sf_dir)
    adjusted = adjusted_prices(bars, adapters.type_factors(spark, sf_dir), ["amount"])
    prices = {"total-return": scan_research(bars, pin(adjusted, "adjusted"), "total-return")}
    classes = adapters.table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol"))
    classes = classes.distinct().withColumn("asset_class", F.col("symbol"))
    run = research.run_research(prices, classes, settings.ADJUSTED_SCENARIOS, settings.SPEC)
    return _daily(run.daily)


@query
def core_strategy(spark, sf_dir):
    """The main report's parameters on raw and adjusted prices in one run."""
    bars = pin(adapters.type_bars(spark, sf_dir), "bars")
    adjusted = adjusted_prices(bars, adapters.type_factors(spark, sf_dir), ["amount"])
    adjusted = pin(adjusted, "adjusted")
    prices = {
        mode: scan_research(bars, adjusted, mode) for mode in ("raw", "total-return")
    }
    run = research.run_research(
        prices, adapters.type_classes(spark, sf_dir), settings.CORE_SCENARIOS
    )
    return _daily(run.daily)
