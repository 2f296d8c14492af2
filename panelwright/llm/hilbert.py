"""Sharding along a Hilbert curve over document metadata, in DataFrame operations only.

Several metadata columns are quantised to the cells of a cube; documents are sorted by the index of
their cell on the Hilbert curve and the order is cut into runs of equal counts. Cells near on the
curve are near in every dimension, so each shard spans a small range of all of them and readers can
skip files by any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.scratch import pin

#: Cells along each dimension: two to this power.
BITS = 8


def curve_table(dimensions: int) -> tuple[list[int], list[int]]:
    """Steps of the curve: for a state and the next bit of each coordinate, the digit and next state.

    A state is an entry corner and an axis, numbered ``corner * dimensions + axis``. Both lists are
    indexed by ``state * 2**dimensions + bits``.
    """
    n, corners = dimensions, 1 << dimensions

    def turn(value: int, by: int) -> int:
        by %= n
        return ((value << by) | (value >> (n - by))) & (corners - 1)

    gray = [w ^ (w >> 1) for w in range(corners)]
    rank = {g: w for w, g in enumerate(gray)}
    entry = [gray[2 * ((w - 1) // 2)] if w else 0 for w in range(corners)]

    def trailing_ones(w: int) -> int:
        return ((w + 1) & -(w + 1)).bit_length() - 1

    axis = [0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n for w in range(corners)]
    digits, states = [], []
    for corner in range(corners):
        for way in range(n):
            for bits in range(corners):
                digit = rank[turn(bits ^ corner, n - (way + 1) % n)]
                digits.append(digit)
                states.append((corner ^ turn(entry[digit], way + 1)) * n + (way + axis[digit] + 1) % n)
    return digits, states


def curve_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell given by integer columns in [0, 2**bits)."""
    n = len(coordinates)
    digits, states = curve_table(n)
    digit_of = F.array(*[F.lit(x) for x in digits])
    state_of = F.array(*[F.lit(x) for x in states])

    def step(so_far: Column, level: Column) -> Column:
        at = so_far["state"] * (1 << n)
        for k, x in enumerate(coordinates):
            bit = F.call_function("shiftright", x.cast("int"), F.lit(bits - 1) - level).bitwiseAND(F.lit(1))
            at = at + bit * (1 << k)
        return F.struct(
            F.get(state_of, at).alias("state"),
            (so_far["index"] * (1 << n) + F.get(digit_of, at)).alias("index"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step)["index"]


def _ranked(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Quantise a text column by the rank of its values: (value, cell), null first."""
    values = rows.select(F.col(column).alias(f"{column}_value")).distinct()
    rank = F.row_number().over(W.orderBy(F.col(f"{column}_value").asc_nulls_first())) - 1
    count = F.count("*").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    cell = F.floor(rank * F.lit(1 << bits) / F.greatest(count, F.lit(1)))
    return values.withColumn(f"{column}_cell", cell.cast("int"))


def hilbert_shards(documents: DataFrame, *, shards: int = 8, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, curve), one row for every document.

    ``size`` is the text's UTF-8 bytes plus one, and a null text counts as an empty one. The curve
    runs over source, language and the logarithm of the size. Shards hold equal counts of rows, at
    most one apart; ``slot`` numbers a shard's rows from 0 in the order of the curve. Documents of
    one cell are ordered by a hash of their id, so a cell with a third of all rows spreads over many
    tasks. Nulls in source or language form a value of their own; a null id sorts first; repeated
    rows take neighbouring slots. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = pin(rows, "shard-rows")
    for column in ("source", "lang"):
        cells = _ranked(rows, column, bits)
        rows = rows.join(cells, F.col(column).eqNullSafe(F.col(f"{column}_value"))).drop(f"{column}_value")
    bulk = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size")) * 8)).cast("int")
    cell = curve_index([F.col("source_cell"), F.col("lang_cell"), bulk], bits)
    keyed = rows.select(
        "doc_id", "size", "text_crc32", cell.alias("curve"), F.xxhash64("doc_id", "text_crc32").alias("spread")
    )
    order = ["curve", "spread", "doc_id", "text_crc32", "size"]
    ranged = pin(keyed.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "curve-runs")
    counts = ranged.groupBy("run").agg(F.count("*").alias("rows"))
    until = F.sum("rows").over(W.orderBy("run"))
    whole = F.sum("rows").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = counts.select("run", (until - F.col("rows")).alias("before"), whole.alias("total"))
    local = F.row_number().over(W.partitionBy("run").orderBy(*order)) - 1
    position = ranged.withColumn("local", local).join(offsets, "run").withColumn("rank", F.col("before") + F.col("local"))
    shard = F.expr(f"rank * {shards} div total")
    return position.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        # the first rank of shard s is the smallest whole number not below s * total / shards
        (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        "curve",
    )
