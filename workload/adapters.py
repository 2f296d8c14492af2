"""Driver tables as bars, factors, catalogs and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.classify import asset_class
from panelwright.functions.text import padded_symbol
from workload import settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(value: Column | str) -> Column:
    """Six decimals, the same in both engines.

    Spark's floor gives a bigint. Beyond 2^53 a double has no fraction left, so it passes as it is.
    """
    column = F.col(value) if isinstance(value, str) else value
    shifted = column * 1e6 + settings.ROUND_SHIFT
    whole = F.when(F.abs(shifted) < float(2**53), F.floor(shifted).cast("double")).otherwise(shifted)
    return whole / F.lit(1e6)


def session_day(day: Column, days: int) -> Column:
    """First day of the block of ``days`` days that holds ``day``."""
    return day if days == 1 else F.date_sub(day, F.pmod(F.unix_date(day), F.lit(days)))


def part_bars(spark: SparkSession, sf_dir: str, attribute: str, days: int = 1) -> DataFrame:
    """Bars per part attribute over the lines of a session.

    Prices are line revenue scaled to move like fund prices; close is the session's mean.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(attribute).alias("symbol"))
    price = settings.PRICE_BASE + F.col("l_extendedprice") / settings.PRICE_SCALE
    day = session_day(F.col("l_shipdate").cast("date"), days)
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", day.alias("date"))
        .agg(
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.avg(price).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
    )


def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_bars(spark, sf_dir, "p_type")


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_bars(spark, sf_dir, "p_brand")


def brand_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand bars over blocks of three days, dense enough for full windows."""
    return part_bars(spark, sf_dir, "p_brand", settings.SESSION_DAYS)


def brand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return brands.withColumn(
        "asset_class",
        asset_class(F.col("symbol"), settings.BRAND_RULES, settings.DEFAULT_CLASS),
    )


def type_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol")).distinct()
    return types.withColumn(
        "asset_class", asset_class(F.col("symbol"), settings.TYPE_RULES, settings.DEFAULT_CLASS)
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw supplier bars: repeated dates, missing and zero values included."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.col("l_shipdate").cast("date")
    flawed = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    return table(spark, sf_dir, "lineitem").select(
        padded_symbol(F.col("l_suppkey")).alias("symbol"),
        F.when(~flawed, day).alias("date"),
        F.lit(None).cast("double").alias("open"),
        F.lit(None).cast("double").alias("high"),
        F.lit(None).cast("double").alias("low"),
        F.when(F.col("l_tax") > 0.075, None)
        .when(F.col("l_discount") > 0.095, 0.0)
        .otherwise(unit)
        .alias("close"),
        F.when(F.col("l_discount") > 0.005, F.col("l_quantity")).alias("volume"),
        F.when(F.col("l_tax") > 0.005, F.col("l_extendedprice")).alias("amount"),
        _line_order().alias("ingest_seq"),
    )


def _line_order() -> Column:
    """Order, line and part number side by side in one long."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * F.lit(10**8) + F.col("l_partkey")


def supplier_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(padded_symbol(F.col("s_suppkey")).alias("symbol"))


def supplier_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a positive balance, named with their region; the others have no entry."""
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey")
    )
    regions = table(spark, sf_dir, "region")
    return (
        suppliers.join(nations, "s_nationkey")
        .join(regions, "r_regionkey")
        .select(
            padded_symbol(F.col("s_suppkey")).alias("symbol"),
            F.concat_ws(" ", "s_name", "r_name").alias("name"),
        )
    )


def type_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly factors per part type from returned lines; some values are missing."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        "l_partkey", "l_discount", F.col("l_shipdate").cast("date").alias("day")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    month = F.trunc("day", "MM")
    monthly = (
        returned.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", month.alias("month"))
        .agg(F.max("day").alias("date"), F.sum("l_discount").alias("paid"))
    )
    running = Window.partitionBy("symbol").orderBy("month").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    number = F.month("month")
    return monthly.select(
        "symbol",
        "date",
        F.lit(1.0).alias("f"),
        F.when(number % 5 != 0, 1.0 + number / 100.0).alias("s"),
        F.when(number % 4 != 0, F.sum("paid").over(running) * 0.01).alias("u"),
    )


def customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        padded_symbol(F.col("c_custkey")).alias("symbol"), F.col("c_name").alias("name")
    )


def order_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on hand per customer; four orders or fewer stand for an empty file."""
    counted = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"))
        .where("orders % 7 != 0")
    )
    return counted.select(
        padded_symbol(F.col("o_custkey")).alias("symbol"),
        F.col("orders").alias("rows"),
        F.when(F.col("orders") > 4, F.col("orders") * 100).otherwise(F.lit(0)).alias("bytes"),
    )


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ingest results: indebted customers failed, rich ones delivered ten rows."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal < -500 OR c_acctbal > 9000")
    failed = F.col("c_acctbal") < 0
    return customers.select(
        padded_symbol(F.col("c_custkey")).alias("symbol"),
        F.col("c_name").alias("name"),
        F.when(failed, 0).otherwise(10).cast("long").alias("rows"),
        F.when(failed, "").otherwise("vendor").alias("source"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, "timeout").otherwise("").alias("error"),
    )
