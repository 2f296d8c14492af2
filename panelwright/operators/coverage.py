"""What a catalog still misses: pending symbols and the status of every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import schemas

# Fixed value: error text of a symbol without any data file.
NO_FILE = "未找到历史文件"


def pending(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """Catalog rows whose symbol is not in the inventory yet."""
    return catalog.join(inventory.select("symbol").distinct(), "symbol", "left_anti")


def coverage(
    catalog: DataFrame, inventory: DataFrame, results: DataFrame | None = None
) -> DataFrame:
    """Status of every catalog symbol.

    New results win, then what the inventory holds (symbol, rows, bytes), else failed. An
    inventory entry of zero bytes counts as missing; one with a header only counts as present
    with 0 rows.
    """
    columns = schemas.column_names(schemas.FETCH_RESULTS)
    held = inventory.select("symbol", F.col("rows").alias("held_rows"), "bytes")
    rows = catalog.join(held, "symbol", "left")
    fresh_columns = [name for name in columns if name not in ("symbol", "name")]
    if results is None:
        rows = rows.select("*", F.lit(None).alias("fresh"))
    else:
        fresh = results.select("symbol", F.struct("name", *fresh_columns).alias("fresh"))
        rows = rows.join(fresh, "symbol", "left")
    present = F.coalesce(F.col("bytes") > 0, F.lit(False))
    known = {
        "rows": F.when(present, F.col("held_rows")).otherwise(F.lit(0)).cast("long"),
        "source": F.when(present, F.lit("existing")).otherwise(F.lit("")),
        "status": F.when(present, F.lit("ok")).otherwise(F.lit("failed")),
        "error": F.when(present, F.lit("")).otherwise(F.lit(NO_FILE)),
    }
    if results is None:
        return rows.select("symbol", "name", *[known[n].alias(n) for n in fresh_columns])
    is_new = F.col("fresh").isNotNull()
    return rows.select(
        "symbol",
        F.when(is_new, F.col("fresh.name")).otherwise(F.col("name")).alias("name"),
        *[
            F.when(is_new, F.col(f"fresh.{n}")).otherwise(known[n]).alias(n)
            for n in fresh_columns
        ],
    )


def failures(report: DataFrame) -> DataFrame:
    return report.where("status = 'failed'")


def totals(report: DataFrame, waiting: DataFrame) -> DataFrame:
    """One row: catalog size, pending, succeeded and failed symbols."""
    return report.agg(
        F.count(F.lit(1)).alias("catalog"),
        F.count_if(F.col("status") == "ok").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("pending", waiting.select(F.count(F.lit(1))).scalar())
