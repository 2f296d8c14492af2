"""Backward as-of join: each left row takes the latest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.scratch import pin

# A key with more rows than this is cut into time buckets.
HOT_KEY_ROWS = 5_000_000


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: str,
    on: str,
    values: Sequence[str],
    bucket: Column | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
    order: str | None = None,
) -> DataFrame:
    """Left rows with ``values`` of the latest right row where right.on <= left.on, per ``by``.

    The right row is taken whole: its NULL values stay NULL. Left rows without a match get
    NULLs. Both sides are put together and the latest right row is carried forward, so there
    is one shuffle and no range condition. NULL keys and dates match nothing: such left rows stay
    unmatched, such right rows are left out.

    Of right rows with equal key and date the last by ``order``, a column of the right side, counts;
    without one, and for equal orders, the one with the largest ``values``.

    ``bucket`` is for keys whose row count has no bound: a column over ``on`` that never
    decreases with it. Keys with more than ``hot_key_rows`` rows are then spread over their
    buckets, and each bucket starts from the last right row before it. For tables with one row
    per key and date leave it out; a key is bounded by the calendar there.
    """
    kept = [name for name in left.columns if name not in (by, on)]
    keyed = F.col(by).isNotNull() & F.col(on).isNotNull()
    place = F.lit(None).cast("long") if order is None else F.col(order)
    lefts = left.select(by, on, F.struct(*kept).alias("l"), F.lit(1).alias("side"))
    rights = right.where(keyed).select(
        by, on, F.struct(*values).alias("r"), F.lit(0).alias("side"), place.alias("place")
    )
    rows = lefts.where(keyed).unionByName(rights, allowMissingColumns=True)
    if bucket is None:
        matched = rows.withColumn("r", _carry(_in_order(on, by)))
    else:
        matched = _bucketed(rows, by, on, bucket, hot_key_rows)
    both = matched.where("side = 1").select(by, on, "l", "r").unionByName(
        lefts.where(~keyed).select(by, on, "l"), allowMissingColumns=True
    )
    return both.select(by, on, "l.*", *[F.col(f"r.{name}").alias(name) for name in values])


def _in_order(on: str, *keys: str):
    """Right rows before left rows of the same date, ties among them by place and values."""
    return Window.partitionBy(*keys).orderBy(on, "side", "place", "r")


def _carry(window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last("r", ignorenulls=True).over(frame)


def _bucketed(
    rows: DataFrame, by: str, on: str, bucket: Column, hot_key_rows: int
) -> DataFrame:
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    # At most row count / hot_key_rows keys can pass, so this list stays small.
    hot = pin(counts.where(F.col("n") > hot_key_rows).select(by, F.lit(True).alias("hot")), "hot")
    marked = rows.join(hot, by, "left").withColumn("bucket", F.when(F.col("hot"), bucket))

    last_right = F.max_by("r", F.when(F.col("side") == 0, F.struct(on, "place", "r")))
    buckets = marked.where("hot").groupBy(by, "bucket").agg(last_right.alias("r"))
    earlier = (
        Window.partitionBy(by)
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = pin(
        buckets.select(by, "bucket", F.last("r", ignorenulls=True).over(earlier).alias("before")),
        "carry",
    )
    inside = marked.withColumn("r", _carry(_in_order(on, by, "bucket")))
    return inside.join(carried, [by, "bucket"], "left").withColumn(
        "r", F.coalesce("r", "before")
    )
