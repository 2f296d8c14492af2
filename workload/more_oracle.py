"""SQL for the queries of ``more_queries``, written from the definitions."""

from __future__ import annotations

from workload import settings
from workload.oracle import (
    ADJUSTED,
    FACTORS,
    QUALITY,
    QUALITY_DOUBLES,
    QUALITY_PLAIN,
    RAW_LINES,
    SNAPSHOT,
    SQL,
    TYPE_BARS,
    fixed,
    fixed_as,
    padded,
    with_ctes,
)

SQL["duplicate_bars"] = with_ctes(
    [RAW_LINES],
    "SELECT symbol, date, count(*) AS rows FROM raw_lines WHERE date IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
)
SQL["asof_ties"] = f"""
WITH keyed AS (
    SELECT CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id,
           CASE WHEN event_id % 11 <> 0 THEN date_trunc('day', ts) END AS ts, event_id, event_type, value
    FROM events),
others AS (
    SELECT user_id, ts, max(event_id) AS other_id, arg_max(value, event_id) AS other_value
    FROM keyed WHERE event_type <> 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
SELECT p.user_id, p.event_id, o.other_id, {fixed("o.other_value")} AS other_value
FROM (SELECT * FROM keyed WHERE event_type = 'purchase') p
LEFT JOIN others o ON o.user_id = p.user_id AND o.ts =
    (SELECT max(x.ts) FROM others x WHERE x.user_id = p.user_id AND x.ts <= p.ts)"""
SQL["asof_ties_hot"] = SQL["asof_ties"]
SQL["bars_from_files"] = SQL["bars_dedupe_last"]
SQL["series_first"] = f"""
SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, {fixed("arg_min(o_totalprice, o_orderkey)")} AS nav
FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2"""
SQL["factor_guard"] = with_ctes(
    [FACTORS],
    f"""SELECT replace(symbol, ' ', '_') AS symbol, date, {fixed("1.0")} AS f, {fixed_as("s", "u")}
    FROM factors WHERE month(date) <> 6""",
)
SQL["adjusted_join"] = with_ctes(
    [TYPE_BARS, FACTORS, ADJUSTED],
    f"""SELECT symbol, date, {fixed("total_return_proxy")} AS close, {fixed("amount")} AS amount
    FROM adjusted WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
)
SQL["combined_series"] = with_ctes([TYPE_BARS], f"SELECT symbol, date, {fixed('close')} AS close FROM bars")
SQL["universe_config"] = """
SELECT p_type AS asset, upper(p_type) AS signal_symbol,
       CASE WHEN p_type = 'STANDARD' THEN '' ELSE lower(p_type) END AS signal_name,
       CAST(p_type = 'STANDARD' AS INTEGER) AS defensive
FROM part GROUP BY p_type"""
SQL["wide_round_trip"] = SQL["combined_series"]
SQL["catalog_round_trip"] = f"""
SELECT {padded("c_custkey")} AS symbol, CASE WHEN c_custkey % 9 <> 0 THEN c_name ELSE '' END AS name FROM customer"""
SQL["quality_round_trip"] = with_ctes(QUALITY, f"SELECT {QUALITY_PLAIN}, {QUALITY_DOUBLES} FROM quality")
SQL["bars_by_year"] = with_ctes(
    [TYPE_BARS],
    f"""SELECT CAST(year(date) AS INTEGER) AS year, symbol, count(*) AS rows, min(date) AS first_date,
    {fixed("max(close)")} AS top_close FROM bars GROUP BY ALL""",
)
SQL["research_universe_totals"] = with_ctes(
    [
        *QUALITY,
        ("live", "SELECT *, date_diff('day', last_date, max(last_date) OVER ()) AS stale FROM quality"),
        (
            "ranked",
            """SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY median_amount_60d DESC, symbol) AS place
            FROM live WHERE rows_valid >= 450 AND stale <= 20 AND median_amount_60d >= 40000""",
        ),
        ("chosen", "SELECT * FROM ranked WHERE place <= CASE WHEN asset_class = 'cash' THEN 3 ELSE 5 END"),
    ],
    """
    SELECT (SELECT max(last_date) FROM quality) AS as_of, count(*) AS selected,
           (SELECT string_agg(asset_class || ':' || n, ';' ORDER BY asset_class)
            FROM (SELECT asset_class, count(*) AS n FROM chosen GROUP BY 1)) AS classes
    FROM chosen""",
)
SQL["total_return_build"] = with_ctes(
    [TYPE_BARS, FACTORS],
    f"""
    SELECT symbol, CASE WHEN symbol = 'LARGE' THEN 'failed' ELSE 'done' END AS status,
           CASE WHEN symbol = 'LARGE' THEN 0 ELSE count(*) END AS rows,
           CASE WHEN symbol <> 'LARGE' THEN {fixed("max(price)")} END AS top_price
    FROM (SELECT b.symbol, b.close * coalesce(f.s, 1.0) + coalesce(f.u, 0.0) AS price
          FROM bars b ASOF LEFT JOIN (SELECT * FROM factors WHERE symbol <> 'ECONOMY') f
            ON b.symbol = f.symbol AND b.date >= f.date)
    GROUP BY symbol""",
)
# Two keywords of each class and a word of none, stated apart from the library's rules.
SQL["classify_names"] = """
WITH words(i, word) AS (VALUES (0, '货币'), (1, '短融'), (2, '黄金'), (3, 'QDII'), (4, '红利'), (5, '中证'),
                               (6, '半导体'), (7, '零钱'), (8, '信用'), (9, '油气'), (10, '纳指'), (11, '价值'), (12, '1000')),
named AS (
    SELECT a.word || p_brand || CASE WHEN p_partkey % 3 = 0 THEN b.word ELSE '' END AS name
    FROM part JOIN words a ON a.i = p_partkey % 13 JOIN words b ON b.i = (p_partkey // 3) % 13),
counted AS (SELECT name, count(*) AS parts FROM named GROUP BY name)
SELECT name, CASE
    WHEN regexp_matches(name, '货币|零钱') THEN 'cash'
    WHEN regexp_matches(name, '短融|信用') THEN 'bond'
    WHEN regexp_matches(name, '黄金|油气') THEN 'commodity'
    WHEN regexp_matches(name, 'QDII|纳指') THEN 'overseas'
    WHEN regexp_matches(name, '红利|价值') THEN 'equity_dividend'
    WHEN regexp_matches(name, '中证|1000') THEN 'equity_broad'
    ELSE 'equity_thematic' END AS asset_class, parts
FROM counted"""
SQL["rotation_files"] = SQL["rotation_daily"]
SQL["adjusted_files"] = SQL["asof_adjust"]
SQL["total_return_table"] = with_ctes(
    [TYPE_BARS, FACTORS],
    f"""
    SELECT b.symbol, b.date, {fixed("b.close * coalesce(f.s, 1.0) + coalesce(f.u, 0.0)")} AS price,
           {fixed("b.amount")} AS amount
    FROM bars b ASOF LEFT JOIN (SELECT * FROM factors WHERE symbol <> 'ECONOMY') f
      ON b.symbol = f.symbol AND b.date >= f.date
    WHERE b.symbol <> 'LARGE'
    UNION ALL SELECT 'LARGE', NULL, NULL, NULL""",
)
SQL["snapshot_report"] = with_ctes(
    SNAPSHOT,
    f"""
    SELECT symbol, asset_class, eligible, exclusion_reason, stale_days,
           {fixed("median_amount_60d")} AS median_amount_60d,
           CAST(row_number() OVER (PARTITION BY eligible, asset_class
                                   ORDER BY median_amount_60d DESC, symbol) AS INTEGER) AS rank
    FROM snapshot""",
)
SQL["research_pool_report"] = f"""
WITH pool AS ({SQL["research_universe"]}), quality AS ({SQL["quality_audit"]})
SELECT symbol, name, asset_class, rows_valid, last_date, median_amount_60d,
       CAST(row_number() OVER (PARTITION BY asset_class ORDER BY median_amount_60d DESC, symbol) AS INTEGER) AS rank,
       (SELECT max(last_date) FROM quality) AS as_of, count(*) OVER () AS selected
FROM pool"""
SQL["research_report_orders"] = SQL["research_orders"]
SQL["research_report_summary"] = f"""
WITH metrics AS ({SQL["summary_metrics"]}),
labels(scenario_id, price_mode, top_n, cost_bps) AS (VALUES {
    ", ".join(f"('{s.scenario_id}', '{s.price_mode}', {s.top_n}, {s.cost_bps}::DOUBLE)" for s in settings.SCENARIOS)
})
SELECT * FROM metrics JOIN labels USING (scenario_id)"""
SQL["bucketed_volatility"] = SQL["rolling_vol"]
