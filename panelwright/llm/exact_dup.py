"""Exact duplicates by a 128-bit content hash, in DataFrame operations only.

Rows are grouped by a hash of their text; counts and the row that stays are aggregated before anything
is shuffled, so a group may hold any share of the rows. A hash proves nothing by itself: the texts below
each hash are compared byte by byte, and the rows of a hash that stands for several texts are grouped anew
by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.scratch import pin


def content_hash(sha256: Column, text: Column) -> Column:
    """The first 128 bits of the text's SHA-256, which is at hand anyway."""
    return F.substring(sha256, 1, 16)


def exact_duplicates(
    documents: DataFrame,
    *,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hashed: Callable[[Column, Column], Column] = content_hash,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for every row of ``documents``.

    Rows are equal if their texts are, byte for byte, after ``normalise`` (nothing by default); a null
    text counts as an empty one, so null and empty texts are one group. Of each group one row stays, that
    of the smallest or largest doc_id; ``keep_id`` is its doc_id. Of rows that repeat both doc_id and text
    one stays, and a row without an id stays only if its whole group has none (``keep_id`` is null then).
    ``text_sha256`` is the lower-case hexadecimal SHA-256 of the normalised text in UTF-8. ``hashed`` turns
    (SHA-256, text) into the key of the first grouping; any function of the text gives the same result.
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sha.alias("sha"))
    texts = texts.withColumn("hash", hashed(F.col("sha"), F.col("text")))

    rows = pin(texts.select("doc_id", "sha", "hash", F.monotonically_increasing_id().alias("row")), "digests")
    groups = pin(_repeated(rows, ["hash"], keep), "groups")
    # equal texts of a task become one before the shuffle, so a large group of copies is no large partition
    versions = texts.select("hash", "text").distinct().groupBy("hash").agg(F.count("*").alias("texts"))
    mixed = pin(versions.where("texts > 1").select("hash"), "collisions")
    if mixed.isEmpty():
        return _marked(rows, groups, ["hash"])

    apart = texts.join(mixed, "hash", "left_semi").withColumn("row", F.monotonically_increasing_id())
    apart = pin(apart, "collided")
    by_text = _marked(apart, _repeated(apart, ["hash", "text"], keep), ["hash", "text"])
    return _marked(rows.join(mixed, "hash", "left_anti"), groups, ["hash"]).unionByName(by_text)


def _repeated(rows: DataFrame, key: list[str], keep: str) -> DataFrame:
    """Keys of more than one row, with their size and the row that stays."""
    # ids from the one that stays to the last, rows without an id behind them all
    first = F.struct(
        F.col("doc_id").isNull().alias("without"),
        (F.col("doc_id") if keep == "smallest" else F.bitwise_not("doc_id")).alias("rank"),
        F.col("row").alias("keep_row"),
        F.col("doc_id").alias("keep_id"),
    )
    sized = rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
    return sized.where("group_size > 1").select(*key, "group_size", "first.keep_id", "first.keep_row")


def _marked(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    alone = F.col("group_size").isNull()
    return rows.join(groups, key, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
