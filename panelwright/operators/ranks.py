"""Exact values at given ranks of a column, without sorting it in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.scratch import pin


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of the non-NULL values, interpolated between neighbours; None without any.

    Equal values are counted before they are sorted, so one value may hold any share of the rows.
    The distinct values are sorted by range over all tasks; only the partitions in which a rank lies
    are numbered, and the driver sees one row for each partition and each rank.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    ranged = pin(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.sum("rows").alias("rows")).orderBy("part").collect()
    total = sum(size.rows for size in sizes)
    if not total:
        return [None] * len(shares)
    positions = [share * (total - 1) for share in shares]
    ranks = sorted({rank for at in positions for rank in (math.floor(at), math.ceil(at))})
    before, wanted = 0, []
    for size in sizes:
        wanted += [(size.part, rank, rank - before) for rank in ranks if before <= rank < before + size.rows]
        before += size.rows
    inside = ranged.where(F.col("part").isin(sorted({part for part, _, _ in wanted})))
    until = F.sum("rows").over(Window.partitionBy("part").orderBy("value"))
    placed = inside.withColumn("until", until)
    hit = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("part") == part)
                    & (F.col("until") > local)
                    & (F.col("until") - F.col("rows") <= local),
                    F.lit(rank),
                )
                for part, rank, local in wanted
            ]
        )
    )
    found = placed.select("value", F.explode(hit).alias("rank")).collect()
    value = {row.rank: row.value for row in found}
    result = []
    for at in positions:
        low, high = math.floor(at), math.ceil(at)
        whole = low == high
        result.append(value[low] if whole else (high - at) * value[low] + (at - low) * value[high])
    return result
