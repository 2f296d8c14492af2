"""Dynamic-universe rotation over many parameter sets in one job.

What scenarios share is computed once: signals per price mode (all trend windows in the same
pass), picks per distinct selection rule, weights per distinct pair of caps. Only the daily
series, a few thousand rows each, exist per scenario.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.classify import CASH, DEFENSIVE_CLASSES, UNKNOWN_CLASS
from panelwright.functions.folds import capped_inverse_vol
from panelwright.functions.numbers import finite, ratio
from panelwright.operators import cross_section, overlays, performance, rolling
from panelwright.operators.calendar import rebalance_dates, slot_calendar
from panelwright.operators.panel import attach_slots, is_repeated, refuse_repeated
from panelwright.operators.selection import eligible, top_n_per_category, with_fallback
from panelwright.scratch import pin
from panelwright.sources import sinks
from panelwright.sources.tables import RAW, scan_research


@dataclass(frozen=True)
class Scenario:
    """One parameter set. Zero switches an overlay off."""

    scenario_id: str
    price_mode: str = RAW
    min_history_rows: int = 252
    max_stale_days: int = 30
    min_median_amount_60d: float = 10_000_000.0
    top_n: int = 5
    max_per_category: int = 2
    single_cap: float = 0.30
    category_cap: float = 0.40
    cost_bps: float = 15.0
    trend_window: int = 120
    breadth_threshold: float = 0.0
    target_vol: float = 0.0
    stop_drawdown: float = 0.0
    stop_reentry_breadth: float = 0.50

    @property
    def selection(self) -> tuple:
        return (
            self.trend_window,
            self.min_history_rows,
            self.max_stale_days,
            float(self.min_median_amount_60d),
            self.top_n,
            self.max_per_category,
        )

    @property
    def target(self) -> tuple:
        return (self.selection, float(self.single_cap), float(self.category_cap))

    def parameters(self) -> dict[str, str]:
        values = asdict(self)
        return {k: str(v) for k, v in values.items() if k not in ("scenario_id", "price_mode")}


# The configuration used for the main report: ten names, at most three per category, a longer
# trend and a volatility target on adjusted prices.
CORE = Scenario(
    "core",
    price_mode="total-return",
    top_n=10,
    max_per_category=3,
    trend_window=200,
    target_vol=0.12,
)


@dataclass(frozen=True)
class SignalSpec:
    """Windows of the signal, in calendar slots, and the weight of each momentum term."""

    momentum: tuple[tuple[int, float], ...] = ((60, 0.5), (120, 0.3), (252, 0.2))
    vol_window: int = 20
    liquidity_window: int = 60
    realised_window: int = 60
    realised_minimum: int = 20
    # Slots by which breadth is lagged for the re-entry test; 0 tests the same date.
    reentry_lag: int = 0


class ResearchRun(NamedTuple):
    daily: DataFrame
    orders: DataFrame
    weights: DataFrame
    summary: DataFrame


def _ratio_name(window: int) -> str:
    return f"ratio_{window}"


def _trend_name(window: int) -> str:
    return f"trend_{window}"


def research_signals(
    prices: DataFrame,
    classes: DataFrame,
    calendar: DataFrame,
    trend_windows: Sequence[int],
    spec: SignalSpec = SignalSpec(),
) -> DataFrame:
    """Signals per existing (symbol, date) row of (symbol, date, close, amount).

    One shuffle by symbol serves every window. A trend without a full window is false here, not
    NULL. What only signal dates use is NULL on other dates, which keeps the table small.
    """
    close = F.col("close")
    rows = attach_slots(prices, calendar, "is_rebalance", "active_signal_pos").join(
        classes.select("symbol", "asset_class"), "symbol", "left"
    )
    averages = {f"average_{window}": window for window in trend_windows}
    averaged = rolling.with_moving_averages(rows, "close", averages)
    liquid = rolling.with_moving_median(
        averaged, "amount", "liquidity", spec.liquidity_window, F.col("is_rebalance")
    )
    measured = liquid.select(
        "symbol",
        "date",
        "pos",
        "is_rebalance",
        "active_signal_pos",
        "close",
        F.coalesce("asset_class", F.lit(UNKNOWN_CLASS)).alias("asset_class"),
        rolling.simple_return(close).alias("ret"),
        *[
            rolling.simple_return(close, window).alias(f"momentum_{window}")
            for window, _ in spec.momentum
        ],
        *[
            F.coalesce(close > F.col(name), F.lit(False)).alias(_trend_name(window))
            for name, window in averages.items()
        ],
        "liquidity",
        rolling.history_count(close).alias("history"),
        rolling.stale_days(close, F.col("date")).alias("stale_days"),
        is_repeated().alias("repeated"),
    )
    with_vol = measured.withColumn("vol", rolling.volatility(F.col("ret"), spec.vol_window))
    def on_signal(column: Column, name: str) -> Column:
        return F.when(F.col("is_rebalance"), column).alias(name)

    return with_vol.select(
        "symbol",
        "date",
        "pos",
        "is_rebalance",
        "active_signal_pos",
        "asset_class",
        "ret",
        "repeated",
        *[_trend_name(window) for window in trend_windows],
        on_signal(close.isNotNull(), "priced"),
        on_signal(F.col("vol"), "vol"),
        *[
            on_signal(ratio(F.col(f"momentum_{window}"), F.col("vol")), _ratio_name(window))
            for window, _ in spec.momentum
        ],
        *[on_signal(F.col(name), name) for name in ("liquidity", "history", "stale_days")],
    )


def is_risk() -> Column:
    return F.col("asset_class") != CASH


def market_by_date(
    signals: DataFrame,
    calendar: DataFrame,
    trend_windows: Sequence[int],
    spec: SignalSpec = SignalSpec(),
) -> DataFrame:
    """The calendar with what each date knows about the whole cross-section.

    Breadth per trend window, moments of the momentum ratios, and the first cash or bond symbol
    with a price as the fallback name. All are partial aggregates of one row per date.
    """
    risk_symbols = signals.where(is_risk()).select(F.count_distinct("symbol")).scalar()
    stats = signals.groupBy("pos").agg(
        *[
            F.count_if(F.col(_trend_name(w)) & is_risk()).alias(f"rising_{w}")
            for w in trend_windows
        ],
        *cross_section.moments([_ratio_name(w) for w, _ in spec.momentum]),
    )
    defensive = signals.where(
        F.col("is_rebalance") & F.col("priced") & F.col("asset_class").isin(*DEFENSIVE_CLASSES)
    )
    fallback = defensive.groupBy("pos").agg(
        F.min(F.struct("symbol", "asset_class", "vol")).alias("fallback")
    )
    moments = [
        f"{_ratio_name(w)}_{kind}" for w, _ in spec.momentum for kind in ("mean", "std")
    ]
    return (
        calendar.join(stats, "pos", "left")
        .join(fallback, "pos", "left")
        .select(
            *calendar.columns,
            *[
                ratio(
                    F.coalesce(f"rising_{w}", F.lit(0)).cast("double"),
                    risk_symbols.cast("double"),
                ).alias(f"breadth_{w}")
                for w in trend_windows
            ],
            *moments,
            "fallback",
        )
    )


def local_table(spark: SparkSession, schema: pa.Schema, rows: Iterable[tuple]) -> DataFrame:
    """Driver-side parameters as a local relation, whose size Catalyst knows."""
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


SELECTION_SCHEMA = pa.schema(
    [
        ("selection_id", pa.int32()),
        ("trend_window", pa.int32()),
        ("min_history_rows", pa.int64()),
        ("max_stale_days", pa.int32()),
        ("min_median_amount", pa.float64()),
        ("top_n", pa.int32()),
        ("max_per_category", pa.int32()),
    ]
)
TARGET_SCHEMA = pa.schema(
    [
        ("target_id", pa.int32()),
        ("selection_id", pa.int32()),
        ("single_cap", pa.float64()),
        ("category_cap", pa.float64()),
    ]
)
AXIS_SCHEMA = pa.schema(
    [
        ("scenario_id", pa.string()),
        ("target_id", pa.int32()),
        ("selection_id", pa.int32()),
        ("trend_window", pa.int32()),
        ("cost_bps", pa.float64()),
        ("breadth_threshold", pa.float64()),
        ("target_vol", pa.float64()),
        ("stop_drawdown", pa.float64()),
        ("stop_reentry_breadth", pa.float64()),
    ]
)


class ScenarioTables(NamedTuple):
    selections: DataFrame
    targets: DataFrame
    axis: DataFrame
    selection_count: int


def scenario_tables(spark: SparkSession, scenarios: Sequence[Scenario]) -> ScenarioTables:
    """Scenarios split into their distinct selection rules, cap pairs and overlay settings."""
    selections = {key: i for i, key in enumerate(dict.fromkeys(s.selection for s in scenarios))}
    targets = {key: i for i, key in enumerate(dict.fromkeys(s.target for s in scenarios))}
    return ScenarioTables(
        local_table(spark, SELECTION_SCHEMA, [(i, *key) for key, i in selections.items()]),
        local_table(
            spark,
            TARGET_SCHEMA,
            [(i, selections[rule], single, group) for (rule, single, group), i in targets.items()],
        ),
        local_table(
            spark,
            AXIS_SCHEMA,
            [
                (
                    s.scenario_id,
                    targets[s.target],
                    selections[s.selection],
                    s.trend_window,
                    float(s.cost_bps),
                    float(s.breadth_threshold),
                    float(s.target_vol),
                    float(s.stop_drawdown),
                    float(s.stop_reentry_breadth),
                )
                for s in scenarios
            ],
        ),
        len(selections),
    )


def scored_candidates(
    signals: DataFrame,
    market: DataFrame,
    trend_windows: Sequence[int],
    spec: SignalSpec = SignalSpec(),
) -> DataFrame:
    """Risk names with a score on signal dates, one row per trend window they rise in."""
    rising = F.array_compact(
        F.array(*[F.when(F.col(_trend_name(w)), F.lit(w)) for w in trend_windows])
    )
    names = [_ratio_name(w) for w, _ in spec.momentum]
    any_trend = reduce(Column.__or__, [F.col(_trend_name(w)) for w in trend_windows])
    rows = signals.where(F.col("is_rebalance") & is_risk() & any_trend).na.drop(subset=names)
    moments = [f"{name}_{kind}" for name in names for kind in ("mean", "std")]
    live = market.where("is_rebalance AND next_date IS NOT NULL").select("pos", *moments)
    scored = rows.join(live, "pos").select(
        "symbol",
        "pos",
        "asset_class",
        "vol",
        "history",
        "liquidity",
        "stale_days",
        cross_section.composite(
            [(_ratio_name(window), weight) for window, weight in spec.momentum]
        ).alias("score"),
        rising.alias("rising"),
    )
    return scored.where("score IS NOT NULL").select(
        "*", F.explode("rising").alias("trend_window")
    ).drop("rising")


def selection_orders(
    candidates: DataFrame, market: DataFrame, tables: ScenarioTables, scenarios: Sequence[Scenario]
) -> DataFrame:
    """Selected names per (selection rule, signal date), with the fallback filled in."""
    rules = tables.selections
    # The weakest thresholds cut rows before they are paired with the rules.
    loosest = candidates.where(
        (F.col("history") >= min(s.min_history_rows for s in scenarios))
        & (F.col("liquidity") >= min(float(s.min_median_amount_60d) for s in scenarios))
    )
    allowed = loosest.join(rules, "trend_window").where(
        eligible(
            F.col("history"),
            F.col("liquidity"),
            F.col("stale_days"),
            F.lit(True),
            F.lit(True),
            F.col("min_history_rows"),
            F.col("min_median_amount"),
            F.col("max_stale_days"),
        )
    )
    best = top_n_per_category(
        allowed,
        ["selection_id", "pos"],
        max(s.top_n for s in scenarios),
        max(s.max_per_category for s in scenarios),
        limit_column="top_n",
        per_category_column="max_per_category",
    )
    picked = best.groupBy("selection_id", F.col("pos").alias("signal_pos")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "symbol", "asset_class", "vol"))).alias(
            "picked"
        )
    )
    fallback = F.when(
        F.col("fallback").isNotNull(), F.struct(F.lit(1).alias("rank"), "fallback.*")
    )
    signal_dates = rebalance_dates(market).join(
        market.select(F.col("pos").alias("signal_pos"), "fallback"), "signal_pos"
    )
    every_rule = F.sequence(F.lit(0), F.lit(tables.selection_count - 1))
    return (
        signal_dates.withColumn("selection_id", F.explode(every_rule))
        .join(picked, ["selection_id", "signal_pos"], "left")
        .withColumn("names", with_fallback(F.col("picked"), fallback))
        .drop("picked", "fallback")
    )


def target_weights(ordered: DataFrame, tables: ScenarioTables) -> DataFrame:
    """Capped inverse-volatility weights per (target, signal, name)."""
    sized = ordered.select("selection_id", "signal_pos", "names").join(
        tables.targets, "selection_id"
    )
    weights = capped_inverse_vol(F.col("names"), F.col("single_cap"), F.col("category_cap"))
    return sized.select("target_id", "signal_pos", F.inline(weights))


def scenario_axis(
    market: DataFrame,
    gross: DataFrame,
    tables: ScenarioTables,
    trend_windows: Sequence[int],
    with_stop: bool,
    spec: SignalSpec = SignalSpec(),
) -> DataFrame:
    """Every date of every scenario with its unscaled gross return and overlay multiplier."""
    by_window = market.select(
        "pos",
        "date",
        "active_signal_pos",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(w).alias("trend_window"), F.col(f"breadth_{w}").alias("breadth")
                    )
                    for w in trend_windows
                ]
            )
        ),
    )
    rows = (
        by_window.join(tables.axis, "trend_window")
        .join(gross, ["target_id", "pos"], "left")
        .withColumn("unit_gross", F.coalesce("unit_gross", F.lit(0.0)))
        .withColumn(
            "gate", overlays.breadth_gate(F.col("breadth"), F.col("breadth_threshold"))
        )
        .withColumn("gated", F.col("gate") * F.col("unit_gross"))
        .withColumn(
            "raw_scale",
            overlays.vol_scale(
                F.col("gated"),
                F.col("target_vol"),
                spec.realised_window,
                spec.realised_minimum,
            ),
        )
        .withColumn("scale", overlays.lagged_scale(F.col("raw_scale"), F.col("target_vol")))
        .withColumn("multiplier", F.col("gate") * F.col("scale"))
        .drop("raw_scale")
    )
    if not with_stop:
        return rows
    reentry = "breadth"
    if spec.reentry_lag:
        rows = rows.withColumn(
            "reentry_breadth",
            F.lag("breadth", spec.reentry_lag).over(overlays.by_scenario()),
        )
        reentry = "reentry_breadth"
    scaled = rows.withColumn("scaled", F.col("multiplier") * F.col("unit_gross"))
    stopped = overlays.drawdown_stop(scaled, "scaled", reentry)
    return stopped.withColumn(
        "multiplier", F.when(F.col("stopped"), F.lit(0.0)).otherwise(F.col("multiplier"))
    )


def _pin_modes(frames: Mapping[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """Pin one table for all price modes, in one job, and return each mode's rows."""
    if len(frames) == 1:
        return {mode: pin(frame, label) for mode, frame in frames.items()}
    marked = [frame.withColumn("price_mode", F.lit(mode)) for mode, frame in frames.items()]
    stored = pin(
        reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), marked), label
    )
    return {
        mode: stored.where(F.col("price_mode") == mode).select(*frame.columns)
        for mode, frame in frames.items()
    }


def _run_modes(
    prices_by_mode: Mapping[str, DataFrame],
    classes: DataFrame,
    scenarios_by_mode: Mapping[str, Sequence[Scenario]],
    spec: SignalSpec,
) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Daily series, orders and weights of each price mode; the modes share every job."""
    modes = list(scenarios_by_mode)
    prices = {
        mode: prices_by_mode[mode].select(
            "symbol",
            "date",
            finite(F.col("close")).alias("close"),
            finite(F.col("amount")).alias("amount"),
        )
        for mode in modes
    }
    spark = classes.sparkSession
    windows = {m: sorted({s.trend_window for s in scenarios_by_mode[m]}) for m in modes}
    tables = {m: scenario_tables(spark, scenarios_by_mode[m]) for m in modes}
    calendars = _pin_modes({m: slot_calendar(prices[m]) for m in modes}, "calendar")
    measured = _pin_modes(
        {m: research_signals(prices[m], classes, calendars[m], windows[m], spec) for m in modes},
        "signals",
    )
    signals = {m: refuse_repeated(measured[m]) for m in modes}
    markets = _pin_modes(
        {m: market_by_date(signals[m], calendars[m], windows[m], spec) for m in modes}, "market"
    )
    ordered = _pin_modes(
        {
            m: selection_orders(
                scored_candidates(signals[m], markets[m], windows[m], spec),
                markets[m],
                tables[m],
                scenarios_by_mode[m],
            )
            for m in modes
        },
        "orders",
    )
    targets = _pin_modes({m: target_weights(ordered[m], tables[m]) for m in modes}, "targets")
    return [
        _mode_results(
            signals[m], markets[m], ordered[m], targets[m], tables[m], windows[m],
            any(s.stop_drawdown > 0 for s in scenarios_by_mode[m]), spec,
        )
        for m in modes
    ]


def _mode_results(
    signals: DataFrame,
    market: DataFrame,
    ordered: DataFrame,
    targets: DataFrame,
    tables: ScenarioTables,
    trend_windows: Sequence[int],
    with_stop: bool,
    spec: SignalSpec,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    gross = performance.unit_gross(targets, signals)
    axis = scenario_axis(market, gross, tables, trend_windows, with_stop, spec)
    daily = performance.daily_result(
        axis,
        performance.switch_legs(targets, rebalance_dates(market)),
        performance.invested(targets),
    )
    ids = tables.axis.select("scenario_id", "selection_id", "target_id")
    orders = ordered.join(ids, "selection_id").select(
        "scenario_id",
        "signal_date",
        "execution_date",
        F.transform("names", lambda n: n["symbol"]).alias("selected"),
        F.size("names").alias("selected_count"),
    )
    # Weights before overlays; the daily series holds their effect.
    weights = performance.daily_weights(targets, market).join(ids, "target_id").select(
        "scenario_id", "date", "pos", "symbol", "weight"
    )
    return daily, orders, weights


def run_research(
    prices_by_mode: Mapping[str, DataFrame],
    classes: DataFrame,
    scenarios: Sequence[Scenario],
    spec: SignalSpec = SignalSpec(),
) -> ResearchRun:
    """Run all scenarios. ``prices_by_mode`` has (symbol, date, close, amount) per price mode."""
    if len({s.scenario_id for s in scenarios}) != len(scenarios):
        raise ValueError("scenario ids must be unique")
    by_mode: dict[str, list[Scenario]] = {}
    for scenario in scenarios:
        by_mode.setdefault(scenario.price_mode, []).append(scenario)
    runs = _run_modes(prices_by_mode, classes, by_mode, spec)
    daily, orders, weights = (
        reduce(DataFrame.unionByName, parts) for parts in zip(*runs, strict=True)
    )
    summary = performance.summarize(daily, orders).join(
        scenario_labels(daily.sparkSession, scenarios), "scenario_id"
    )
    return ResearchRun(daily, orders, weights, summary)


def scenario_labels(spark: SparkSession, scenarios: Sequence[Scenario]) -> DataFrame:
    """scenario_id, price_mode and all parameters as a map of text."""
    schema = pa.schema(
        [
            ("scenario_id", pa.string()),
            ("price_mode", pa.string()),
            ("parameters", pa.map_(pa.string(), pa.string())),
        ]
    )
    rows = [
        (s.scenario_id, s.price_mode, list(s.parameters().items())) for s in scenarios
    ]
    return local_table(spark, schema, rows)


def research_report(
    bars: DataFrame,
    quality: DataFrame,
    scenarios: Sequence[Scenario],
    output: str,
    adjusted: DataFrame | None = None,
    symbols: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    spec: SignalSpec = SignalSpec(),
) -> ResearchRun:
    """Run all scenarios on stored tables and write daily series, orders and summaries."""
    modes = {s.price_mode for s in scenarios}
    prices = {
        mode: scan_research(bars, adjusted, mode, symbols, start, end) for mode in modes
    }
    run = run_research(prices, quality, scenarios, spec)
    daily = pin(run.daily, "daily")
    summary = performance.summarize(daily, run.orders).join(
        scenario_labels(daily.sparkSession, scenarios), "scenario_id"
    )
    sinks.write_run(daily.drop("pos"), run.orders, summary, output)
    return ResearchRun(daily, run.orders, run.weights, summary)
