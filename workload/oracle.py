"""The same queries as DuckDB SQL over the driver tables.

Written from the definitions, not from the Spark plans: panels are dense here, windows count
rows, and every weight is spread over its dates before returns and turnover are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from panelwright.plans.research import Scenario, SignalSpec
from panelwright.plans.rotation import RotationConfig
from workload import settings

SQL: dict[str, str] = {}

Rules = Sequence[tuple[str, Sequence[str]]]
# Fixed values, stated here apart from the library: the default class rules in order of precedence,
# the class of all other names, and the reason given for a missing file.
DEFAULT_RULES: Rules = (
    ("cash", ("货币", "快线", "添益", "零钱")),
    ("bond", ("债", "国债", "信用", "短融", "中短")),
    ("commodity", ("黄金", "有色", "商品", "原油", "油气")),
    ("overseas", ("恒生", "港股", "纳指", "纳斯达克", "标普", "美国", "全球", "qdii")),
    ("equity_dividend", ("红利", "股息", "价值")),
    ("equity_broad", ("沪深", "中证", "上证", "深证", "创业板", "科创", "50etf", "300", "500", "1000")),
)
DEFAULT_CLASS = "equity_thematic"
NO_FILE = "未找到历史文件"


def fixed(value: str) -> str:
    return f"floor(({value}) * 1e6 + {settings.ROUND_SHIFT}) / 1e6"


def fixed_as(*names: str) -> str:
    return ", ".join(f"{fixed(name)} AS {name}" for name in names)


def with_ctes(parts: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts)
    return f"WITH RECURSIVE {body}\n{final}"


def class_case(text: str, rules: Rules, default: str) -> str:
    branches = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in rules
    )
    return f"CASE {branches} ELSE '{default}' END"


def padded(value: str) -> str:
    return f"lpad(CAST({value} AS VARCHAR), 6, '0')"


def friday(day: str) -> str:
    return f"CAST({day} + CAST((12 - isodow({day})) % 7 AS INTEGER) AS DATE)"


# Bars


def part_bars(attribute: str, days: int = 1) -> str:
    day = "CAST(l_shipdate AS DATE)"
    if days > 1:
        day = f"CAST({day} - CAST(date_diff('day', DATE '1970-01-01', {day}) % {days} AS INTEGER) AS DATE)"
    price = f"{settings.PRICE_BASE} + l_extendedprice / {settings.PRICE_SCALE}"
    return f"""
    SELECT {attribute} AS symbol, {day} AS date,
           max({price}) AS high, min({price}) AS low, avg({price}) AS close,
           sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


TYPE_BARS = ("bars", part_bars("p_type"))
BRAND_BARS = ("bars", part_bars("p_brand"))
BRAND_SESSIONS = ("bars", part_bars("p_brand", settings.SESSION_DAYS))

RAW_LINES = (
    "raw_lines",
    f"""
    SELECT {padded("l_suppkey")} AS symbol,
           CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber = 7)
                THEN CAST(l_shipdate AS DATE) END AS date,
           CASE WHEN l_tax > 0.075 THEN NULL WHEN l_discount > 0.095 THEN 0.0
                ELSE l_extendedprice / l_quantity END AS close,
           CASE WHEN l_discount > 0.005 THEN l_quantity END AS volume,
           CASE WHEN l_tax > 0.005 THEN l_extendedprice END AS amount,
           l_orderkey, l_linenumber, l_partkey
    FROM lineitem""",
)
SEQ = ("l_orderkey", "l_linenumber", "l_partkey")


def kept(direction: str) -> str:
    order = ", ".join(f"{name} {direction}" for name in SEQ)
    return f"""
    SELECT symbol, date, close, volume, amount FROM raw_lines
    WHERE date IS NOT NULL AND close IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY {order}) = 1"""


CLEAN = ("clean", kept("DESC"))

SQL["bars_rollup"] = with_ctes(
    [TYPE_BARS],
    f"SELECT symbol, date, {fixed_as('high', 'low', 'close', 'volume', 'amount')} FROM bars",
)
for name, direction in (("bars_dedupe_last", "DESC"), ("bars_dedupe_first", "ASC")):
    SQL[name] = with_ctes(
        [RAW_LINES, ("clean", kept(direction))],
        f"SELECT symbol, date, {fixed_as('close', 'volume', 'amount')} FROM clean",
    )

SQL["bars_missing_cast"] = f"""
WITH text AS (
  SELECT o_orderpriority,
         CASE o_orderstatus WHEN 'P' THEN 'x' || strftime(o_orderdate, '%Y-%m-%d')
              WHEN 'F' THEN strftime(o_orderdate, '%Y%m%d')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_text,
         CASE WHEN o_orderpriority LIKE '5%' THEN CAST(o_totalprice AS VARCHAR) || ' CNY'
              WHEN o_orderpriority LIKE '3%' THEN 'nan'
              ELSE CAST(o_totalprice AS VARCHAR) END AS price_text
  FROM orders),
typed AS (
  SELECT o_orderpriority,
         CAST(coalesce(try_strptime(day_text, '%Y-%m-%d'), try_strptime(day_text, '%Y%m%d'))
              AS DATE) AS day,
         CASE WHEN isfinite(TRY_CAST(price_text AS DOUBLE))
              THEN TRY_CAST(price_text AS DOUBLE) END AS price
  FROM text)
SELECT o_orderpriority, count(*) AS rows, count(day) AS days, count(price) AS prices,
       min(day) AS first_day, max(day) AS last_day, {fixed("max(price)")} AS top_price
FROM typed GROUP BY 1"""

CATALOG = (
    "catalog",
    f"""
    SELECT {padded("s_suppkey")} AS symbol, s_name || ' ' || r_name AS name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE s_acctbal > 0""",
)

SQL["range_filter"] = with_ctes(
    [RAW_LINES, CLEAN, CATALOG],
    """SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date
    FROM clean WHERE symbol IN (SELECT symbol FROM catalog)
      AND date BETWEEN DATE '1996-02-01' AND DATE '1999-06-30' GROUP BY 1""",
)

QUALITY = [
    RAW_LINES,
    CLEAN,
    CATALOG,
    (
        "raw_stats",
        """
    SELECT symbol, count(*) AS rows_raw,
           count(*) - count(DISTINCT date) - CAST(bool_or(date IS NULL) AS INTEGER)
             AS duplicate_dates,
           count(*) FILTER (WHERE close IS NULL) AS null_close,
           count(*) FILTER (WHERE coalesce(close, 0) <= 0) AS non_positive_close
    FROM raw_lines GROUP BY 1""",
    ),
    (
        "clean_stats",
        """
    SELECT symbol, count(*) AS rows_valid, min(date) AS first_date, max(date) AS last_date
    FROM clean GROUP BY 1""",
    ),
    (
        "tail_stats",
        """
    SELECT symbol, median(amount) AS amount,
           avg(CASE WHEN coalesce(volume, 0) <= 0 THEN 1.0 ELSE 0.0 END) AS zero_volume
    FROM (SELECT * FROM clean
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60)
    GROUP BY 1""",
    ),
    (
        "quality",
        f"""
    SELECT i.symbol, coalesce(c.name, i.symbol) AS name,
           {class_case("coalesce(c.name, i.symbol)", settings.REGION_RULES, settings.DEFAULT_CLASS)}
             AS asset_class,
           CAST(coalesce(rows_raw, 0) AS BIGINT) AS rows_raw,
           CAST(coalesce(rows_valid, 0) AS BIGINT) AS rows_valid,
           CAST(coalesce(duplicate_dates, 0) AS BIGINT) AS duplicate_dates,
           CAST(coalesce(null_close, 0) AS BIGINT) AS null_close,
           CAST(coalesce(non_positive_close, 0) AS BIGINT) AS non_positive_close,
           first_date, last_date,
           CAST(coalesce(date_diff('day', first_date, last_date), 0) AS INTEGER) AS span_days,
           coalesce(amount, 0.0) AS median_amount_60d,
           coalesce(zero_volume, 1.0) AS zero_volume_ratio_60d
    FROM (SELECT {padded("s_suppkey")} AS symbol FROM supplier) i
    LEFT JOIN raw_stats USING (symbol) LEFT JOIN clean_stats USING (symbol)
    LEFT JOIN tail_stats USING (symbol) LEFT JOIN catalog c ON c.symbol = i.symbol""",
    ),
]
QUALITY_PLAIN = (
    "symbol, name, asset_class, rows_raw, rows_valid, duplicate_dates, null_close, "
    "non_positive_close, first_date, last_date, span_days"
)
QUALITY_DOUBLES = fixed_as("median_amount_60d", "zero_volume_ratio_60d")

SQL["quality_audit"] = with_ctes(
    QUALITY, f"SELECT {QUALITY_PLAIN}, {QUALITY_DOUBLES} FROM quality"
)
SQL["quality_summary"] = with_ctes(
    QUALITY,
    f"""
    SELECT (SELECT count(*) FROM catalog) AS catalog_count, count(*) AS history_count,
           count(*) FILTER (WHERE rows_valid > 0) AS valid_count,
           CAST(sum(rows_valid) AS BIGINT) AS total_daily_rows,
           {fixed("median(rows_valid)")} AS median_history_rows,
           {fixed("quantile_cont(median_amount_60d, 0.25)")} AS amount_q25,
           {fixed("quantile_cont(median_amount_60d, 0.50)")} AS amount_q50,
           {fixed("quantile_cont(median_amount_60d, 0.75)")} AS amount_q75,
           (SELECT string_agg(asset_class || ':' || n, ';' ORDER BY asset_class)
            FROM (SELECT asset_class, count(*) AS n FROM quality GROUP BY 1)) AS classes
    FROM quality""",
)
SQL["quality_by_class"] = with_ctes(
    QUALITY, "SELECT asset_class, count(*) AS symbols FROM quality GROUP BY 1"
)
SQL["classify_rules"] = f"""
SELECT p_name, {class_case("p_name", settings.PART_RULES, settings.DEFAULT_CLASS)} AS asset_class,
       count(*) AS parts FROM part GROUP BY 1, 2"""
SQL["classify_documents"] = f"""
SELECT lang, {class_case("text", DEFAULT_RULES, DEFAULT_CLASS)} AS asset_class,
       count(*) AS documents FROM documents GROUP BY 1, 2"""


def snapshot_cte(history: int, stale: int, amount: float) -> tuple[str, str]:
    rules = [
        (f"rows_valid < {history}", f"history<{history}"),
        (f"stale_days > {stale}", f"stale>{stale}d"),
        (f"median_amount_60d < {amount}", f"amount<{amount:g}"),
        ("asset_class IN ('cash')", "excluded_asset_class"),
    ]
    reasons = ", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in rules)
    return (
        "snapshot",
        f"""
    SELECT *, exclusion_reason = '' AS eligible FROM (
      SELECT *, concat_ws(';', {reasons}) AS exclusion_reason FROM (
        SELECT *, max(last_date) OVER () AS as_of,
               CAST(date_diff('day', last_date, max(last_date) OVER ()) AS INTEGER) AS stale_days
        FROM quality))""",
    )


SNAPSHOT = [
    *QUALITY,
    snapshot_cte(
        settings.SNAPSHOT["min_history_rows"],
        settings.SNAPSHOT["max_stale_days"],
        settings.SNAPSHOT["min_median_amount"],
    ),
]
SQL["universe_snapshot"] = with_ctes(
    SNAPSHOT,
    f"""SELECT {QUALITY_PLAIN}, {QUALITY_DOUBLES}, stale_days, eligible, exclusion_reason
    FROM snapshot""",
)
SQL["universe_by_class"] = with_ctes(
    SNAPSHOT, "SELECT asset_class, count(*) AS symbols FROM snapshot WHERE eligible GROUP BY 1"
)
SQL["universe_totals"] = with_ctes(
    SNAPSHOT,
    """SELECT max(as_of) AS as_of, count(*) AS total, count(*) FILTER (WHERE eligible) AS eligible,
    count(*) FILTER (WHERE NOT eligible) AS excluded FROM snapshot""",
)
SQL["research_universe"] = with_ctes(
    QUALITY,
    f"""
    SELECT symbol, name, asset_class, rows_valid, first_date, last_date,
           {fixed("median_amount_60d")} AS median_amount_60d
    FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_class
                                   ORDER BY median_amount_60d DESC, symbol) AS rank
      FROM quality
      WHERE rows_valid >= {settings.RESEARCH_POOL["min_history_rows"]}
        AND median_amount_60d >= {settings.RESEARCH_POOL["min_median_amount"]}
        AND date_diff('day', last_date, (SELECT max(last_date) FROM quality))
            <= {settings.RESEARCH_POOL["max_stale_days"]})
    WHERE rank <= CASE WHEN asset_class = 'cash' THEN {settings.RESEARCH_POOL["cash_count"]}
                       ELSE {settings.RESEARCH_POOL["per_category"]} END""",
)

INGEST = [
    ("cust", f"SELECT {padded('c_custkey')} AS symbol, c_name AS name, c_acctbal FROM customer"),
    (
        "inventory",
        f"""
    SELECT {padded("o_custkey")} AS symbol, count(*) AS rows,
           CASE WHEN count(*) > 4 THEN count(*) * 100 ELSE 0 END AS bytes
    FROM orders GROUP BY o_custkey HAVING count(*) % 7 <> 0""",
    ),
    (
        "known",
        f"""
    SELECT c.symbol, c.name, c_acctbal,
           CAST(CASE WHEN bytes > 0 THEN i.rows ELSE 0 END AS BIGINT) AS rows,
           CASE WHEN bytes > 0 THEN 'existing' ELSE '' END AS source,
           CASE WHEN bytes > 0 THEN 'ok' ELSE 'failed' END AS status,
           CASE WHEN bytes > 0 THEN '' ELSE '{NO_FILE}' END AS error
    FROM cust c LEFT JOIN inventory i ON c.symbol = i.symbol""",
    ),
]
SQL["ingest_status"] = with_ctes(
    INGEST,
    """
    SELECT symbol, name,
           CASE WHEN c_acctbal < -500 THEN 0 WHEN c_acctbal > 9000 THEN 10 ELSE rows END AS rows,
           CASE WHEN c_acctbal < -500 THEN '' WHEN c_acctbal > 9000 THEN 'vendor'
                ELSE source END AS source,
           CASE WHEN c_acctbal < -500 THEN 'failed' WHEN c_acctbal > 9000 THEN 'ok'
                ELSE status END AS status,
           CASE WHEN c_acctbal < -500 THEN 'timeout' WHEN c_acctbal > 9000 THEN ''
                ELSE error END AS error
    FROM known""",
)
SQL["ingest_totals"] = with_ctes(
    INGEST,
    """
    SELECT count(*) AS catalog, count(*) FILTER (WHERE status = 'ok') AS success,
           count(*) FILTER (WHERE status = 'failed') AS failed,
           (SELECT count(*) FROM cust WHERE symbol NOT IN (SELECT symbol FROM inventory)) AS pending
    FROM known""",
)
SQL["pending_anti"] = with_ctes(
    INGEST,
    "SELECT symbol, name FROM cust WHERE symbol NOT IN (SELECT symbol FROM inventory)",
)

# As-of joins

FACTORS = (
    "factors",
    """
    SELECT symbol, date,
           CASE WHEN month(m) % 5 <> 0 THEN 1.0 + month(m) / 100.0 END AS s,
           CASE WHEN month(m) % 4 <> 0
                THEN sum(paid) OVER (PARTITION BY symbol ORDER BY m
                                     ROWS UNBOUNDED PRECEDING) * 0.01 END AS u
    FROM (SELECT p_type AS symbol, date_trunc('month', l_shipdate) AS m,
                 CAST(max(l_shipdate) AS DATE) AS date, sum(l_discount) AS paid
          FROM lineitem JOIN part ON l_partkey = p_partkey
          WHERE l_returnflag = 'R' GROUP BY 1, 2)""",
)
ADJUSTED = (
    "adjusted",
    """
    SELECT b.symbol, b.date, b.close, b.amount,
           b.close * coalesce(f.s, 1.0) + coalesce(f.u, 0.0) AS total_return_proxy,
           coalesce(f.u, 0.0) AS cumulative_dividend, coalesce(f.s, 1.0) AS split_factor
    FROM bars b ASOF LEFT JOIN factors f ON b.symbol = f.symbol AND b.date >= f.date""",
)
SQL["asof_adjust"] = with_ctes(
    [TYPE_BARS, FACTORS, ADJUSTED],
    f"""SELECT symbol, date,
    {fixed_as("close", "total_return_proxy", "cumulative_dividend", "split_factor")}
    FROM adjusted""",
)
SQL["asof_events"] = f"""
SELECT p.user_id, p.event_id, {fixed("p.value")} AS value, s.event_id AS signup_id,
       {fixed("s.value")} AS signup_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s
  ON p.user_id = s.user_id AND p.ts >= s.ts"""
SQL["asof_events_hot"] = SQL["asof_events"]

# Panel, calendar and rolling measures

CALENDAR = (
    "cal",
    f"""
    SELECT date, pos, week_end, prev_date, next_date, is_rebalance,
           max(CASE WHEN is_rebalance THEN pos END) OVER earlier AS active_signal_pos,
           max(CASE WHEN is_rebalance THEN date END) OVER earlier AS active_signal_date
    FROM (
      SELECT *, next_date IS NULL OR {friday("next_date")} <> week_end AS is_rebalance
      FROM (
        SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos,
               {friday("date")} AS week_end, lag(date) OVER (ORDER BY date) AS prev_date,
               lead(date) OVER (ORDER BY date) AS next_date
        FROM (SELECT DISTINCT date FROM bars)))
    WINDOW earlier AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
PANEL = (
    "panel",
    """
    SELECT c.date, c.pos, s.symbol, b.close, b.amount, c.is_rebalance, c.next_date
    FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
    LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date""",
)
BY_SYMBOL = "PARTITION BY symbol ORDER BY pos"


def change(distance: int, column: str = "close") -> str:
    return (
        f"{column} / nullif(lag({column}, {distance}) OVER ({BY_SYMBOL}), 0) - 1"
    )


def full(measure: str, column: str, size: int) -> str:
    frame = f"({BY_SYMBOL} ROWS {size - 1} PRECEDING)"
    return (
        f"CASE WHEN count({column}) OVER {frame} = {size} "
        f"THEN {measure}({column}) OVER {frame} END"
    )


def vol(size: int) -> str:
    return f"{full('stddev_samp', 'ret', size)} * sqrt(252)"


SQL["panel_dense"] = with_ctes(
    [BRAND_BARS, CALENDAR, PANEL],
    f"SELECT date, pos, symbol, {fixed_as('close', 'amount')} FROM panel",
)
SQL["panel_wide_pivot"] = with_ctes(
    [TYPE_BARS],
    "SELECT date, "
    + ", ".join(
        f"{fixed(f'''max(CASE WHEN symbol = '{name}' THEN close END)''')} AS {name}"
        for name in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    + " FROM bars GROUP BY 1",
)
SQL["panel_unpivot"] = f"""
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
flags AS (SELECT UNNEST(['A', 'N', 'R']) AS symbol),
means AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS symbol,
                 avg(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)
SELECT d.date, f.symbol, {fixed("close")} AS close
FROM days d CROSS JOIN flags f
LEFT JOIN means m ON m.date = d.date AND m.symbol = f.symbol"""


def measured(bars: tuple[str, str], columns: str, source: str = "panel") -> str:
    """Measures over the dense panel, shown for the slots that hold a bar."""
    return with_ctes(
        [
            bars,
            CALENDAR,
            PANEL,
            ("with_ret", f"SELECT *, {change(1)} AS ret FROM panel"),
            ("result", f"SELECT symbol, date, close AS bar, {columns} FROM with_ret"),
        ],
        "SELECT * EXCLUDE (bar) FROM result WHERE bar IS NOT NULL",
    )


SQL["returns_1"] = measured(BRAND_BARS, f"{fixed('ret')} AS ret")
SQL["momentum_k"] = measured(
    BRAND_BARS, ", ".join(f"{fixed(change(k))} AS momentum_{k}" for k in (5, 20, 60))
)
SQL["rolling_vol"] = measured(
    TYPE_BARS, ", ".join(f"{fixed(vol(n))} AS vol_{n}" for n in (5, 20))
)
SQL["trend_ma"] = measured(
    TYPE_BARS,
    ", ".join(f"{fixed(full('avg', 'close', n))} AS ma_{n}" for n in (10, 60))
    + f", close > {full('avg', 'close', 10)} AS trend",
)
SQL["rolling_median_amount"] = measured(
    TYPE_BARS,
    ", ".join(f"{fixed(full('median', 'amount', n))} AS median_{n}" for n in (5, 60)),
)
SQL["history_count"] = measured(
    BRAND_BARS, f"count(close) OVER ({BY_SYMBOL} ROWS UNBOUNDED PRECEDING) AS history"
)
LAST_SEEN = (
    f"max(CASE WHEN close IS NOT NULL THEN date END) OVER ({BY_SYMBOL} ROWS UNBOUNDED PRECEDING)"
)
SQL["staleness"] = with_ctes(
    [BRAND_BARS, CALENDAR, PANEL],
    f"""SELECT symbol, date, {LAST_SEEN} AS last_seen,
    CAST(date_diff('day', {LAST_SEEN}, date) AS INTEGER) AS stale_days FROM panel""",
)

REBALANCES = (
    "rebalances",
    """
    SELECT pos AS signal_pos, date AS signal_date, next_date AS execution_date, week_end,
           active_signal_pos AS replaced_signal_pos
    FROM cal WHERE is_rebalance AND next_date IS NOT NULL""",
)
SQL["rebalance_calendar"] = with_ctes(
    [TYPE_BARS, CALENDAR, REBALANCES], "SELECT * FROM rebalances"
)
SQL["hold_intervals"] = with_ctes(
    [TYPE_BARS, CALENDAR],
    "SELECT date, pos, week_end, active_signal_pos, active_signal_date FROM cal",
)

# Profit and loss, shared by both strategies.
# Needs: cal, with_ret, weights(scenario_id, signal_pos, symbol, weight), scale per date.

DAYS = "scenario_id, date"


def held(multiplier: str = "1.0") -> tuple[str, str]:
    return (
        "held",
        f"""
    SELECT s.scenario_id, c.pos, w.symbol, w.weight * {multiplier} AS weight
    FROM weights w JOIN cal c ON c.active_signal_pos = w.signal_pos
    JOIN series s ON s.scenario_id = w.scenario_id AND s.pos = c.pos""",
    )


PROFIT = [
    (
        "gross",
        """
    SELECT h.scenario_id, h.pos, sum(h.weight * coalesce(r.ret, 0)) AS gross
    FROM held h JOIN with_ret r ON r.pos = h.pos AND r.symbol = h.symbol GROUP BY 1, 2""",
    ),
    (
        "moves",
        """
    SELECT scenario_id, pos, sum(abs(weight)) AS turnover FROM (
      SELECT scenario_id, pos, symbol, sum(weight) AS weight FROM (
        SELECT scenario_id, pos, symbol, weight FROM held
        UNION ALL SELECT scenario_id, pos + 1, symbol, -weight FROM held)
      GROUP BY 1, 2, 3)
    GROUP BY 1, 2""",
    ),
    (
        "priced",
        """
    SELECT s.scenario_id, s.pos, s.date, coalesce(g.gross, 0.0) AS gross_return,
           coalesce(m.turnover, 0.0) AS turnover,
           coalesce(m.turnover, 0.0) * s.cost_bps / 10000 AS cost
    FROM series s LEFT JOIN gross g USING (scenario_id, pos)
    LEFT JOIN moves m USING (scenario_id, pos)""",
    ),
    (
        "daily",
        """
    SELECT scenario_id, pos, date, gross_return, turnover, cost, gross_return - cost AS net_return,
           product(1 + gross_return - cost) OVER (PARTITION BY scenario_id ORDER BY pos
                                                  ROWS UNBOUNDED PRECEDING) AS nav
    FROM priced""",
    ),
]
DAILY = "SELECT scenario_id, date, " + fixed_as(
    "gross_return", "turnover", "cost", "net_return", "nav"
) + " FROM daily"
DRAWDOWN = (
    "drawdowns",
    """
    SELECT *, nav / max(nav) OVER (PARTITION BY scenario_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
              - 1 AS drawdown FROM daily""",
)
SUMMARY = [
    DRAWDOWN,
    (
        "stats",
        """
    SELECT scenario_id, min(date) AS start, max(date) AS "end", arg_max(nav, pos) AS last_nav,
           stddev_samp(net_return) * sqrt(252) AS annualized_volatility,
           min(drawdown) AS max_drawdown, avg(turnover) AS average_daily_turnover,
           sum(cost) AS total_cost
    FROM drawdowns GROUP BY 1""",
    ),
    (
        "grown",
        """
    SELECT *, last_nav - 1 AS total_return,
           pow(last_nav, 1 / greatest(date_diff('day', start, "end") / 365.25, 1 / 365.25)) - 1
             AS annualized_return
    FROM stats""",
    ),
    (
        "metrics",
        """
    SELECT g.*, CASE WHEN max_drawdown < 0 THEN annualized_return / abs(max_drawdown) END AS calmar,
           (SELECT count(*) FROM rebalances) AS rebalance_count
    FROM grown g""",
    ),
]
METRICS = 'SELECT scenario_id, start, "end", rebalance_count, ' + fixed_as(
    "total_return",
    "annualized_return",
    "annualized_volatility",
    "max_drawdown",
    "calmar",
    "average_daily_turnover",
    "total_cost",
) + " FROM metrics"

# Baseline rotation


def rotation_ctes(config: RotationConfig, defensive: str) -> list[tuple[str, str]]:
    average = full("avg", "close", config.trend_window)
    return [
        TYPE_BARS,
        CALENDAR,
        PANEL,
        REBALANCES,
        ("with_ret", f"SELECT *, {change(1)} AS ret FROM panel"),
        (
            "measured",
            f"""
    SELECT *, {change(config.momentum_window)} AS momentum,
           {vol(config.volatility_window)} AS vol, {average} AS average FROM with_ret""",
        ),
        (
            "scored",
            """
    SELECT *, CASE WHEN average IS NOT NULL THEN close > average END AS trend,
           CASE WHEN close > average THEN momentum / nullif(vol, 0) END AS score FROM measured""",
        ),
        (
            "picks",
            f"""
    SELECT * FROM (
      SELECT r.signal_pos, s.symbol,
             row_number() OVER (PARTITION BY r.signal_pos ORDER BY score DESC, symbol) AS rank
      FROM rebalances r JOIN scored s ON s.pos = r.signal_pos WHERE score IS NOT NULL)
    WHERE rank <= {config.top_n}
    UNION ALL
    SELECT signal_pos, '{defensive}', 1 FROM rebalances
    WHERE signal_pos NOT IN (SELECT pos FROM scored WHERE score IS NOT NULL)""",
        ),
        (
            "weights",
            """
    SELECT 'baseline' AS scenario_id, signal_pos, symbol,
           1.0 / count(*) OVER (PARTITION BY signal_pos) AS weight FROM picks""",
        ),
        (
            "series",
            f"SELECT 'baseline' AS scenario_id, pos, date, {config.cost_bps} AS cost_bps FROM cal",
        ),
        held(),
        *PROFIT,
    ]


ROTATION = rotation_ctes(settings.ROTATION, settings.DEFENSIVE)
SQL["rotation_signals"] = with_ctes(
    ROTATION,
    f"""SELECT symbol, date, trend, {fixed("score")} AS score
    FROM scored WHERE close IS NOT NULL""",
)
SQL["rotation_orders"] = with_ctes(
    ROTATION,
    """
    SELECT signal_date, execution_date, selected FROM rebalances
    JOIN (SELECT signal_pos, string_agg(symbol, ',' ORDER BY rank) AS selected
          FROM picks GROUP BY 1) USING (signal_pos)""",
)
SQL["rotation_weights"] = with_ctes(
    ROTATION,
    f"SELECT c.date, h.symbol, {fixed('weight')} AS weight FROM held h JOIN cal c USING (pos)",
)
SQL["rotation_daily"] = with_ctes(ROTATION, DAILY)
SQL["rotation_summary"] = with_ctes([*ROTATION, *SUMMARY], METRICS)

# Dynamic-universe research


def cap_rounds(names: str, rounds: int = 10) -> list[tuple[str, str]]:
    """Capped inverse-volatility weights from ``names`` (scenario_id, signal_pos, symbol,
    asset_class, vol, single_cap, category_cap), one block of steps per round."""
    book = "PARTITION BY scenario_id, signal_pos"
    columns = "scenario_id, signal_pos, symbol, asset_class, raw, single_cap, category_cap"
    parts = [
        (
            "w0",
            f"""
    SELECT {columns}, raw / sum(raw) OVER ({book}) AS w
    FROM (SELECT *, 1 / vol AS raw FROM {names} WHERE vol <> 0)""",
        )
    ]
    for i in range(1, rounds + 1):
        parts += [
            (
                f"clip{i}",
                f"""
    SELECT *, least(w, single_cap) AS w1, bool_or(w > single_cap) OVER ({book}) AS clipped
    FROM w{i - 1}""",
            ),
            (
                f"group{i}",
                f"""
    SELECT *, sum(w1) OVER (PARTITION BY scenario_id, signal_pos, asset_class) AS held
    FROM clip{i}""",
            ),
            (
                f"shrink{i}",
                f"""
    SELECT *, CASE WHEN held > category_cap THEN w1 * (category_cap / held) ELSE w1 END AS w2,
           bool_or(held > category_cap) OVER ({book}) AS shrunk
    FROM group{i}""",
            ),
            (
                f"room{i}",
                f"""
    SELECT *, 1 - sum(w2) OVER ({book}) AS remaining,
           sum(CASE WHEN w2 < single_cap - 1e-9 THEN raw END) OVER ({book}) AS room
    FROM shrink{i}""",
            ),
            (
                f"w{i}",
                f"""
    SELECT {columns},
           CASE WHEN NOT clipped AND NOT shrunk THEN w
                WHEN remaining > 1e-9 AND w2 < single_cap - 1e-9 THEN w2 + raw / room * remaining
                ELSE w2 END AS w
    FROM room{i}""",
            ),
        ]
    parts.append(
        (
            "weights",
            f"""
    SELECT scenario_id, signal_pos, symbol, w / sum(w) OVER ({book}) AS weight FROM w{rounds}""",
        )
    )
    return parts


def signal_ctes(
    bars: list[tuple[str, str]], classes: str, trend_windows: list[int], spec: SignalSpec
) -> list[tuple[str, str]]:
    windows = [window for window, _ in spec.momentum]
    momenta = ", ".join(f"{change(k)} AS momentum_{k}" for k in windows)
    trends = ", ".join(
        f"coalesce(close > {full('avg', 'close', n)}, false) AS trend_{n}" for n in trend_windows
    )
    ratios = ", ".join(f"momentum_{k} / nullif(vol, 0) AS ratio_{k}" for k in windows)
    by_date = "PARTITION BY pos"
    zscores = ", ".join(
        f"(ratio_{k} - avg(ratio_{k}) OVER ({by_date})) "
        f"/ nullif(stddev_samp(ratio_{k}) OVER ({by_date}), 0) AS z_{k}"
        for k in windows
    )
    composite = " + ".join(f"{weight} * z_{k}" for k, weight in spec.momentum)
    return [
        *bars,
        CALENDAR,
        PANEL,
        REBALANCES,
        ("classes", classes),
        (
            "with_ret",
            f"""
    SELECT p.*, coalesce(asset_class, 'unknown') AS asset_class, {change(1)} AS ret
    FROM panel p LEFT JOIN classes USING (symbol)""",
        ),
        (
            "measured",
            f"""
    SELECT *, {vol(spec.vol_window)} AS vol, {momenta}, {trends},
           {full("median", "amount", spec.liquidity_window)} AS liquidity,
           count(close) OVER ({BY_SYMBOL} ROWS UNBOUNDED PRECEDING) AS history,
           date_diff('day', {LAST_SEEN}, date) AS stale_days
    FROM with_ret""",
        ),
        ("ratios", f"SELECT *, {ratios} FROM measured"),
        ("zscores", f"SELECT *, {zscores} FROM ratios"),
        ("scored", f"SELECT *, {composite} AS score FROM zscores"),
        (
            "market",
            "SELECT pos, date, "
            + ", ".join(
                f"avg(CASE WHEN trend_{n} THEN 1.0 ELSE 0.0 END) AS breadth_{n}"
                for n in trend_windows
            )
            + " FROM measured WHERE asset_class <> 'cash' GROUP BY 1, 2",
        ),
        (
            "fallbacks",
            """
    SELECT pos AS signal_pos, symbol, asset_class, vol FROM measured
    WHERE asset_class IN ('cash', 'bond') AND close IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY pos ORDER BY symbol) = 1""",
        ),
    ]


def scenario_values(scenarios: tuple[Scenario, ...]) -> tuple[str, str]:
    names = (
        "scenario_id, min_history_rows, max_stale_days, min_amount, top_n, max_per_category, "
        "single_cap, category_cap, cost_bps, trend_window, breadth_threshold, target_vol, "
        "stop_drawdown, reentry"
    )
    rows = ", ".join(
        f"('{s.scenario_id}', {s.min_history_rows}, {s.max_stale_days}, "
        f"{s.min_median_amount_60d!r}::DOUBLE, {s.top_n}, {s.max_per_category}, "
        f"{s.single_cap}::DOUBLE, {s.category_cap}::DOUBLE, {s.cost_bps}::DOUBLE, "
        f"{s.trend_window}, {s.breadth_threshold}::DOUBLE, {s.target_vol}::DOUBLE, "
        f"{s.stop_drawdown}::DOUBLE, {s.stop_reentry_breadth}::DOUBLE)"
        for s in scenarios
    )
    return ("scenarios", f"SELECT * FROM (VALUES {rows}) AS t({names})")


def by_window(prefix: str, trend_windows: list[int]) -> str:
    cases = " ".join(f"WHEN {n} THEN {prefix}_{n}" for n in trend_windows)
    return f"CASE trend_window {cases} END"


def research_ctes(
    bars: list[tuple[str, str]],
    classes: str,
    scenarios: tuple[Scenario, ...],
    spec: SignalSpec,
) -> list[tuple[str, str]]:
    trend_windows = sorted({s.trend_window for s in scenarios})
    by_scenario = "PARTITION BY scenario_id ORDER BY pos"
    realised = f"({by_scenario} ROWS {spec.realised_window - 1} PRECEDING)"
    return [
        *signal_ctes(bars, classes, trend_windows, spec),
        scenario_values(scenarios),
        (
            "ranked",
            f"""
    SELECT c.*, s.pos AS signal_pos, s.symbol, s.asset_class, s.vol, s.score,
           row_number() OVER (PARTITION BY c.scenario_id, s.pos, s.asset_class
                              ORDER BY s.score DESC, s.symbol) AS category_rank
    FROM rebalances r JOIN scored s ON s.pos = r.signal_pos CROSS JOIN scenarios c
    WHERE s.history >= min_history_rows AND s.liquidity >= min_amount
      AND s.stale_days <= max_stale_days AND {by_window("trend", trend_windows)}
      AND s.asset_class <> 'cash' AND s.score IS NOT NULL""",
        ),
        (
            "best",
            """
    SELECT *, row_number() OVER (PARTITION BY scenario_id, signal_pos
                                 ORDER BY score DESC, symbol) AS rank
    FROM ranked WHERE category_rank <= max_per_category
    QUALIFY rank <= top_n""",
        ),
        (
            "picks",
            """
    SELECT scenario_id, signal_pos, symbol, asset_class, vol, single_cap, category_cap, rank
    FROM best
    UNION ALL
    SELECT c.scenario_id, r.signal_pos, f.symbol, f.asset_class, f.vol, c.single_cap,
           c.category_cap, 1
    FROM rebalances r CROSS JOIN scenarios c JOIN fallbacks f USING (signal_pos)
    WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.scenario_id = c.scenario_id
                      AND b.signal_pos = r.signal_pos)""",
        ),
        *cap_rounds("picks"),
        (
            "unit",
            """
    SELECT w.scenario_id, c.pos, sum(w.weight * coalesce(r.ret, 0)) AS unit_gross
    FROM weights w JOIN cal c ON c.active_signal_pos = w.signal_pos
    JOIN with_ret r ON r.pos = c.pos AND r.symbol = w.symbol GROUP BY 1, 2""",
        ),
        (
            "axis",
            f"""
    SELECT s.*, c.pos, c.date, coalesce(u.unit_gross, 0.0) AS unit_gross,
           {by_window("m.breadth", trend_windows)} AS breadth
    FROM scenarios s CROSS JOIN cal c JOIN market m ON m.pos = c.pos
    LEFT JOIN unit u ON u.scenario_id = s.scenario_id AND u.pos = c.pos""",
        ),
        (
            "gates",
            f"""
    SELECT *, CASE WHEN breadth_threshold <= 0
                     OR coalesce(lag(breadth) OVER ({by_scenario}) >= breadth_threshold, false)
                   THEN 1.0 ELSE 0.0 END AS gate
    FROM axis""",
        ),
        (
            "realised",
            f"""
    SELECT *, CASE WHEN count(*) OVER {realised} >= {spec.realised_minimum}
                   THEN stddev_samp(gate * unit_gross) OVER {realised} * sqrt(252) END AS vol
    FROM gates""",
        ),
        (
            "scales",
            f"""
    SELECT *, gate * CASE WHEN target_vol > 0 AND wanted < 1 THEN wanted ELSE 1.0 END AS scale
    FROM (SELECT *, lag(target_vol / nullif(vol, 0)) OVER ({by_scenario}) AS wanted
          FROM realised)""",
        ),
        (
            "stops",
            """
    SELECT scenario_id, pos, 1 + scale * unit_gross AS nav,
           greatest(1.0, 1 + scale * unit_gross) AS high, false AS stopped
    FROM scales WHERE pos = 0
    UNION ALL
    SELECT scenario_id, pos, nav * (1 + CASE WHEN now THEN 0 ELSE g END),
           greatest(high, nav * (1 + CASE WHEN now THEN 0 ELSE g END)), now
    FROM (SELECT s.scenario_id, s.pos, p.nav, p.high, s.scale * s.unit_gross AS g,
                 CASE WHEN s.stop_drawdown <= 0 THEN false
                      WHEN NOT p.stopped THEN p.nav / p.high - 1 <= -s.stop_drawdown
                      ELSE NOT coalesce(s.breadth >= s.reentry, false) END AS now
          FROM stops p JOIN scales s ON s.scenario_id = p.scenario_id AND s.pos = p.pos + 1)""",
        ),
        (
            "series",
            """
    SELECT s.scenario_id, s.pos, s.date, s.cost_bps,
           CASE WHEN t.stopped THEN 0.0 ELSE s.scale END AS multiplier
    FROM scales s JOIN stops t USING (scenario_id, pos)""",
        ),
        held("s.multiplier"),
        *PROFIT,
    ]


BRAND_CLASSES = f"""
    SELECT DISTINCT p_brand AS symbol,
           {class_case("p_brand", settings.BRAND_RULES, settings.DEFAULT_CLASS)} AS asset_class
    FROM part"""
SIGNALS = signal_ctes([BRAND_SESSIONS], BRAND_CLASSES, [5, 8], settings.SPEC)

SQL["zscore_xs"] = with_ctes(
    SIGNALS,
    f"""SELECT symbol, date, {fixed("ratio_4")} AS ratio_4, {fixed("z_4")} AS zscore
    FROM zscores WHERE close IS NOT NULL AND is_rebalance""",
)
SQL["composite_score"] = with_ctes(
    SIGNALS,
    " UNION ALL ".join(
        f"""SELECT symbol, pos, {n} AS trend_window, {fixed("score")} AS score FROM scored
    WHERE trend_{n} AND asset_class <> 'cash' AND score IS NOT NULL
      AND is_rebalance AND next_date IS NOT NULL"""
        for n in (5, 8)
    ),
)
SQL["breadth"] = with_ctes(
    SIGNALS, f"SELECT date, {fixed_as('breadth_5', 'breadth_8')} FROM market"
)
SQL["defensive_fallback"] = with_ctes(
    SIGNALS,
    f"""SELECT date, f.symbol, {fixed("f.vol")} AS vol
    FROM cal LEFT JOIN fallbacks f ON f.signal_pos = cal.pos WHERE is_rebalance""",
)
CANDIDATES = [
    *SIGNALS,
    (
        "candidates",
        """
    SELECT 'one' AS scenario_id, pos AS signal_pos, symbol, asset_class, vol, score,
           row_number() OVER (PARTITION BY pos, asset_class ORDER BY score DESC, symbol)
             AS category_rank
    FROM scored WHERE trend_5 AND asset_class <> 'cash' AND score IS NOT NULL
      AND is_rebalance AND next_date IS NOT NULL""",
    ),
]


def capped_pick(limit: int, per_category: int) -> tuple[str, str]:
    return (
        "picks",
        f"""
    SELECT *, row_number() OVER (PARTITION BY signal_pos ORDER BY score DESC, symbol) AS rank
    FROM candidates WHERE category_rank <= {per_category} QUALIFY rank <= {limit}""",
    )


SQL["topn_plain"] = with_ctes(
    CANDIDATES,
    """SELECT signal_pos AS pos, symbol, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY signal_pos ORDER BY score DESC, symbol) AS rank
    FROM candidates) WHERE rank <= 3""",
)
SQL["topn_category_cap"] = with_ctes(
    [*CANDIDATES, capped_pick(5, 2)],
    "SELECT signal_pos AS pos, symbol, asset_class, CAST(rank AS INTEGER) AS rank FROM picks",
)
for name, single_cap, category_cap in (
    ("invvol_raw", 1.0, 1.0),
    ("invvol_capped", 0.2, 0.35),
):
    SQL[name] = with_ctes(
        [
            *CANDIDATES,
            capped_pick(8, 3),
            (
                "sized",
                f"""SELECT *, {single_cap}::DOUBLE AS single_cap,
                {category_cap}::DOUBLE AS category_cap FROM picks""",
            ),
            *cap_rounds("sized"),
        ],
        f"SELECT signal_pos AS pos, symbol, {fixed('weight')} AS weight FROM weights",
    )

RESEARCH = research_ctes([BRAND_SESSIONS], BRAND_CLASSES, settings.SCENARIOS, settings.SPEC)
SQL["research_orders"] = with_ctes(
    RESEARCH,
    """
    SELECT s.scenario_id, r.signal_date, r.execution_date,
           coalesce(string_agg(p.symbol, ',' ORDER BY p.rank), '') AS selected,
           CAST(count(p.symbol) AS INTEGER) AS selected_count
    FROM rebalances r CROSS JOIN scenarios s
    LEFT JOIN picks p ON p.signal_pos = r.signal_pos AND p.scenario_id = s.scenario_id
    GROUP BY 1, 2, 3""",
)
SQL["research_weights"] = with_ctes(
    RESEARCH,
    f"""SELECT w.scenario_id, c.date, w.symbol, {fixed("w.weight")} AS weight
    FROM weights w JOIN cal c ON c.active_signal_pos = w.signal_pos""",
)
for name, scenario_id in settings.SINGLE_RUNS.items():
    chosen = tuple(s for s in settings.SCENARIOS if s.scenario_id == scenario_id)
    SQL[name] = with_ctes(
        research_ctes([BRAND_SESSIONS], BRAND_CLASSES, chosen, settings.SPEC), DAILY
    )
SQL["scenario_grid"] = with_ctes(RESEARCH, DAILY)
SQL["nav_drawdown"] = with_ctes(
    [*RESEARCH, DRAWDOWN],
    f"SELECT scenario_id, date, {fixed('drawdown')} AS drawdown FROM drawdowns",
)
SQL["summary_metrics"] = with_ctes([*RESEARCH, *SUMMARY], METRICS)
ADJUSTED_BARS = [
    ("raw_bars", TYPE_BARS[1]),
    FACTORS,
    ("adjusted", ADJUSTED[1].replace("FROM bars b", "FROM raw_bars b")),
    ("bars", "SELECT symbol, date, total_return_proxy AS close, amount FROM adjusted"),
]
TYPE_CLASSES = f"""
    SELECT DISTINCT p_type AS symbol,
           {class_case("p_type", settings.TYPE_RULES, settings.DEFAULT_CLASS)} AS asset_class
    FROM part"""
SQL["core_strategy"] = " UNION ALL ".join(
    "SELECT * FROM ("
    + with_ctes(
        research_ctes(
            bars,
            TYPE_CLASSES,
            tuple(s for s in settings.CORE_SCENARIOS if s.price_mode == mode),
            SignalSpec(),
        ),
        DAILY,
    )
    + ")"
    for mode, bars in (("total-return", ADJUSTED_BARS), ("raw", [TYPE_BARS]))
)
SQL["total_return_research"] = with_ctes(
    research_ctes(
        ADJUSTED_BARS,
        "SELECT DISTINCT p_type AS symbol, p_type AS asset_class FROM part",
        settings.ADJUSTED_SCENARIOS,
        settings.SPEC,
    ),
    DAILY,
)
