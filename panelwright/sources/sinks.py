"""Writers for tables, reports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_year(rows: DataFrame, path: str) -> None:
    """Full rebuild of a (symbol, date) table, one folder per year.

    The rebalance hint lets adaptive execution split a large year over several tasks and merge
    small ones, so neither a hot year nor a swarm of small files comes out.
    """
    yearly = rows.withColumn("year", F.year("date")).hint("rebalance", "year")
    yearly.write.mode("overwrite").partitionBy("year").parquet(path)


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Full rebuild as a table bucketed by symbol: later windows by symbol need no shuffle.

    With ``path`` the files go there, else below the session's warehouse.
    """
    spread = rows.repartition(buckets, "symbol").write.mode("overwrite")
    located = spread.option("path", path) if path else spread
    located.bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(table)


def write_report(rows: DataFrame, path: str, *order: object) -> None:
    """CSV report, sorted when an order is given."""
    sorted_rows = rows.orderBy(*order) if order else rows
    sorted_rows.write.mode("overwrite").option("header", True).csv(path)


def write_ordered_report(rows: DataFrame, path: str) -> None:
    """CSV report of rows that carry their own order."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def export_orders(orders: DataFrame) -> DataFrame:
    """Orders with the selected names as comma-joined text."""
    return orders.withColumn("selected", F.array_join("selected", ","))


def write_run(daily: DataFrame, orders: DataFrame, summary: DataFrame, path: str) -> None:
    """Daily series and orders as CSV, one folder per scenario, and the summaries as JSON."""
    for name, rows in (("daily", daily), ("orders", export_orders(orders))):
        rows.write.mode("overwrite").partitionBy("scenario_id").option("header", True).csv(
            f"{path}/{name}"
        )
    summary.write.mode("overwrite").json(f"{path}/summary")
