"""Rolling measures per symbol, counted in calendar slots.

All frames range over ``pos``: a frame of n slots holds n values only when no slot is empty,
so the full-window rule is a count, on sparse rows and on a dense panel alike. All measures of
one table share one shuffle by symbol and one sort by (symbol, pos).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelwright.functions.numbers import annualised, ratio


def slots(first: int, last: int) -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("pos").rangeBetween(first, last)


def up_to_now() -> WindowSpec:
    return slots(Window.unboundedPreceding, Window.currentRow)


def slot_lag(value: Column, distance: int) -> Column:
    """Value exactly ``distance`` slots ago, NULL when that slot is empty."""
    return F.max(value).over(slots(-distance, -distance))


def simple_return(price: Column, distance: int = 1) -> Column:
    """Price change over ``distance`` slots; no gap filling, NULL for a zero base."""
    return ratio(price, slot_lag(price, distance)) - 1.0


def full_window(
    measure: Callable[[Column, WindowSpec], Column], value: Column, size: int
) -> Column:
    """``measure`` over the last ``size`` slots, NULL unless every one of them has a value."""
    frame = slots(-(size - 1), Window.currentRow)
    return F.when(F.count(value).over(frame) == size, measure(value, frame))


def volatility(returns: Column, size: int) -> Column:
    """Annualised sample deviation of a full window of returns."""
    return annualised(full_window(lambda c, w: F.stddev_samp(c).over(w), returns, size))


def with_moving_averages(rows: DataFrame, source: str, windows: Mapping[str, int]) -> DataFrame:
    """Add means of ``source`` over full windows; ``windows`` maps new columns to sizes.

    A sliding frame costs one step per slot of the window for every row. Here slots are cut
    into blocks at least as long as the longest window, so that a window lies in one block or
    in two neighbours, and its sum comes from running sums inside the blocks: a constant number
    of lookups per row. The sums restart with every block, so a bad price cannot spoil the
    precision of later years. A flat window returns its value, free of summation error.

    Rows are clustered by symbol first, which serves the windows by block as well: one shuffle, and
    a sort of its own for the blocks.
    """
    kept = rows.columns
    block = 1 << (max(windows.values()) - 1).bit_length()
    value, offset = F.col(source), F.col("pos") % block
    by_block = Window.partitionBy("symbol", "__block").orderBy("pos")
    so_far = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = rows.repartition("symbol").withColumn("__block", F.floor(F.col("pos") / block)).withColumns(
        {
            "__sum": F.sum(source).over(so_far),
            "__count": F.count(source).over(so_far),
            "__block_sum": F.sum(source).over(whole),
            "__block_count": F.count(source).over(whole),
        }
    )
    # Sums up to and from this slot, where every slot of that part of the block has a value.
    parts = summed.withColumns(
        {
            "__head": F.when(F.col("__count") == offset + 1, F.col("__sum")),
            "__tail": F.when(
                F.col("__block_count") - F.col("__count") + 1 == block - offset,
                F.col("__block_sum") - F.col("__sum") + value,
            ),
            "__before": F.col("__sum") - value,
        }
    )
    looked_up = {
        f"__{part}_{size}": slot_lag(F.col(f"__{part}"), size - 1)
        for size in set(windows.values())
        for part in ("tail", "before", "count")
    }
    previous = slot_lag(value, 1)
    changed = F.when(previous.isNull() | (previous != value), F.col("pos"))
    found = parts.withColumns(looked_up | {"__changed": changed}).withColumn(
        "__flat_from", F.max("__changed").over(up_to_now())
    )

    def mean(size: int) -> Column:
        one_block = F.when(
            F.col("__count") - F.col(f"__count_{size}") + 1 == size,
            F.col("__sum") - F.col(f"__before_{size}"),
        )
        two_blocks = F.col("__head") + F.col(f"__tail_{size}")
        total = F.when(offset >= size - 1, one_block).otherwise(two_blocks)
        is_flat = F.col("pos") - F.col("__flat_from") >= size - 1
        return F.when(total.isNotNull(), F.when(is_flat, value).otherwise(total / size))

    return found.select(*kept, *[mean(size).alias(name) for name, size in windows.items()])


def with_moving_median(
    rows: DataFrame, source: str, name: str, size: int, needed: Column | None = None
) -> DataFrame:
    """Add the median of a full window of at most ``size`` values.

    With ``needed``, rows where it is false get NULL and skip the sort.
    """
    frame = slots(-(size - 1), Window.currentRow)
    full = F.size("__values") == size
    low, high = F.lit((size - 1) // 2), F.lit(size // 2)
    # The list is a column of its own: inside one expression it would be sorted for every row.
    listed = rows.withColumn("__values", F.collect_list(source).over(frame)).withColumn(
        "__values",
        F.when(full if needed is None else full & needed, F.sort_array("__values")),
    )
    median = (F.get("__values", low) + F.get("__values", high)) / 2.0
    return listed.select(*rows.columns, median.alias(name))


def history_count(value: Column) -> Column:
    return F.count(value).over(up_to_now())


def last_seen(value: Column, day: Column) -> Column:
    """Last date with a value, up to now."""
    return F.max(F.when(value.isNotNull(), day)).over(up_to_now())


def stale_days(value: Column, day: Column) -> Column:
    return F.datediff(day, last_seen(value, day))
