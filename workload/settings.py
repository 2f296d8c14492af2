"""Parameters shared by the Spark queries and the SQL they are compared with."""

from __future__ import annotations

from dataclasses import replace

from panelwright.plans.research import CORE, Scenario, SignalSpec
from panelwright.plans.rotation import RotationConfig

# Sub-micro shift that keeps short decimal fractions off the rounding boundary.
ROUND_SHIFT = 0.4371

# Prices of the bars built from line items: base plus revenue over scale.
PRICE_BASE = 100.0
PRICE_SCALE = 10_000.0

ROTATION = RotationConfig(
    top_n=2, cost_bps=10.0, momentum_window=10, volatility_window=5, trend_window=10
)
DEFENSIVE = "STANDARD"

SPEC = SignalSpec(
    momentum=((4, 0.5), (8, 0.3), (16, 0.2)),
    vol_window=4,
    liquidity_window=4,
    realised_window=20,
    realised_minimum=5,
)
SESSION_DAYS = 3


def _scenario(name: str, **changes) -> Scenario:
    shared = {
        "min_history_rows": 20,
        "max_stale_days": 10,
        "min_median_amount_60d": 80_000.0,
        "trend_window": 5,
    }
    return Scenario(name, **(shared | changes))


SCENARIOS = (
    _scenario("base"),
    _scenario("wide", top_n=10, max_per_category=3, trend_window=8),
    _scenario("tight", single_cap=0.15, category_cap=0.25, top_n=8, max_per_category=4),
    _scenario("gated", breadth_threshold=0.25),
    _scenario("vol_target", target_vol=0.08, trend_window=8),
    _scenario("stop", stop_drawdown=0.03, stop_reentry_breadth=0.35),
    _scenario(
        "combined",
        top_n=10,
        max_per_category=3,
        breadth_threshold=0.2,
        target_vol=0.08,
        stop_drawdown=0.025,
        stop_reentry_breadth=0.3,
        cost_bps=5.0,
    ),
    _scenario("illiquid", min_median_amount_60d=1e12),
)

# Keyword rules for the names in the driver tables, in order of precedence.
REGION_RULES = (
    ("cash", ("africa",)),
    ("bond", ("middle east",)),
    ("commodity", ("asia",)),
    ("overseas", ("america",)),
)
BRAND_RULES = (
    ("cash", ("brand#25", "brand#24")),
    ("bond", ("brand#23", "brand#22")),
    ("commodity", ("brand#2", "brand#9")),
    ("overseas", ("brand#10", "brand#11", "brand#12", "brand#13")),
    ("equity_dividend", ("brand#1",)),
)
TYPE_RULES = (("cash", ("promo",)), ("bond", ("standard",)), ("commodity", ("economy",)))
PART_RULES = (
    ("cash", ("blue", "green")),
    ("bond", ("ring",)),
    ("commodity", ("hot", "bolt")),
    ("overseas", ("large", "small")),
)
DEFAULT_CLASS = "equity_thematic"

SNAPSHOT = {"min_history_rows": 470, "max_stale_days": 6, "min_median_amount": 48_000.0}
RESEARCH_POOL = {
    "per_category": 5,
    "cash_count": 3,
    "min_history_rows": 450,
    "max_stale_days": 20,
    "min_median_amount": 40_000.0,
}
# Buckets of a table stored by symbol.
BUCKETS = 4
# As-of join over events: rows above which a user is cut into buckets.
HOT_USER_ROWS = 60

# Queries that run one scenario alone.
SINGLE_RUNS = {
    "turnover_cost": "base",
    "breadth_gate": "gated",
    "vol_target": "vol_target",
    "drawdown_stop": "stop",
}
ADJUSTED_SCENARIOS = (
    _scenario(
        "adjusted",
        price_mode="total-return",
        top_n=3,
        max_per_category=1,
        min_median_amount_60d=50_000.0,
        target_vol=0.08,
    ),
)

# The main report's parameters on both price modes, with the default signal windows.
CORE_SCENARIOS = (
    replace(CORE, min_median_amount_60d=100_000.0),
    replace(
        CORE,
        scenario_id="core_raw",
        price_mode="raw",
        trend_window=120,
        min_median_amount_60d=100_000.0,
        breadth_threshold=0.05,
        stop_drawdown=0.02,
        stop_reentry_breadth=0.2,
    ),
)

# Words of names that hit each default class rule, and one that hits none.
CLASS_WORDS = (
    "货币", "短融", "黄金", "QDII", "红利", "中证", "半导体", "零钱", "信用", "油气", "纳指", "价值", "1000",
)
