"""Coverage report of an ingest folder against its catalog."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators.coverage import coverage, failures, pending, totals
from panelwright.sources import files, sinks


class Coverage(NamedTuple):
    report: DataFrame
    failed: DataFrame
    waiting: DataFrame
    totals: DataFrame


def ingest_coverage(
    catalog: DataFrame,
    inventory: DataFrame,
    results: DataFrame | None = None,
    resume: bool = True,
) -> Coverage:
    """Status of every catalog symbol; ``waiting`` is the work that was pending.

    ``inventory`` has (symbol, bytes, rows); ``results`` holds rows of a new ingest, if any.
    Without ``resume`` all symbols count as pending.
    """
    report = coverage(catalog, inventory, results)
    waiting = pending(catalog, inventory) if resume else catalog
    return Coverage(report, failures(report), waiting, totals(report, waiting))


def coverage_from_files(
    spark: SparkSession, bars_path: str, catalog_path: str, output: str | None = None
) -> Coverage:
    inventory = files.count_file_rows(
        files.read_bar_files(spark, bars_path), files.file_inventory(spark, bars_path)
    )
    result = ingest_coverage(files.read_catalog(spark, catalog_path), inventory)
    if output:
        sinks.write_report(result.report, f"{output}/status", "symbol")
        sinks.write_report(result.failed, f"{output}/failed", "symbol")
    return result
