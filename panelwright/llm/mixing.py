"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key, ``-ln(u) / quality``, with ``u`` from a hash of its id: in
the order of these keys a source is a weighted sample without replacement of any length. Rows that share
an id draw by their text and their number among equal rows as well, so each has a key of its own. A source
whose target exceeds its size gives whole epochs first; what is left is taken in key order until a
prefix sum of sizes meets the budget. Only the bucket of keys in which a source's budget ends is
ever sorted, so a source with a third of all documents is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.scratch import pin

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>"
#: Documents of a source that are sorted together, about.
BUCKET_ROWS = 5_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: str = "text", size: Column | None = None) -> Column:
    """Between 0.05 and 1: less for more symbols in a word."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))
    words = F.greatest(word_count(text) if size is None else size, F.lit(1))
    return F.greatest(F.lit(0.05), 1 - symbols / words)


def exponential_key(weight: Column, name: Column) -> Column:
    """-ln(u) / weight; u in (0, 1) has 48 bits and depends on the name alone."""
    bits = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")
    return -F.log((bits + 0.5) / float(2**48)) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """(source, docs, total, target) from (source, docs, total).

    Sources take ``weights`` in turn by code point, null last, and share ``share`` of all words. No
    target exceeds ``epochs`` times its source; the excess goes to the others by weight. That is
    ``min(limit, level * weight)`` for the one level at which the targets add up.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, turn % len(weights))).withColumn(
        "limit", F.col("total") * float(epochs)
    )
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("total").over(everything) * share
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    rows = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(everything))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(
        F.least("limit", F.col("level") * F.col("weight"))
    )
    return rows.select("source", "docs", "total", "mean_weight", target.alias("target"))


def _draws(documents: DataFrame) -> DataFrame:
    sized = documents.withColumn("size", word_count())
    return sized.withColumns(
        {
            "quality_weight": quality_weight(size=F.col("size")),
            "text_key": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )


def _repeated_ids(draws: DataFrame) -> DataFrame:
    """Ids of more than one row; the null id is one of them."""
    counts = draws.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("rows"))
    return pin(counts.where("rows > 1").select("again"), "repeated-ids")


def _keyed(draws: DataFrame, repeated: DataFrame, seed: int) -> DataFrame:
    """Draws with ``copy``, -1 where an id stands once, and ``key``.

    Rows that agree in id, source and text are numbered from 0. Which of them has which number does not
    matter, so tasks number their own rows and only the counts of tasks meet.
    """
    plain = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    longer = F.concat_ws(":", plain, F.col("text_key").cast("string"), F.col("copy").cast("string"))
    name = F.when(F.col("copy") < 0, plain).otherwise(longer)
    key = exponential_key(F.col("quality_weight"), name)
    once = F.lit(-1).cast("long")
    if repeated.isEmpty():
        return draws.withColumn("copy", once).withColumn("key", key)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    alone = draws.join(repeated, same, "left_anti").withColumn("copy", once)
    equal = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "text_key")
    rows = draws.join(repeated, same, "left_semi").withColumns({"equal": equal, "task": F.spark_partition_id()})
    rows = pin(rows, "repeated-rows")
    own = rows.groupBy("equal", "task").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("equal").orderBy("task")) - F.col("rows")
    local = F.row_number().over(W.partitionBy("equal", "task").orderBy("size")) - 1
    numbered = rows.withColumn("local", local).join(own.withColumn("before", before), ["equal", "task"])
    numbered = numbered.withColumn("copy", (F.col("before") + F.col("local")).cast("long"))
    return alone.unionByName(numbered.select(alone.columns)).withColumn("key", key)


def _order() -> Column:
    """Order of the draw; rows that agree in all of it are equal, and so is what becomes of them."""
    return F.struct(
        F.col("key").alias("key"),
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"),
        F.col("size").alias("size"),
        F.col("text_key").alias("text_key"),
        F.col("copy").alias("copy"),
    )


def plan_mix(
    draws: DataFrame, *, weights: tuple[int, ...], share: float, epochs: int, bucket_rows: int
) -> DataFrame:
    """(source, total, target, full, cut): whole epochs, and the last draw of the fraction."""
    sizes = draws.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.sum("size").alias("total"),
        F.avg("quality_weight").alias("mean_weight"),
    )
    plan = source_targets(sizes, weights, share, epochs)
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("int")
    plan = plan.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("total"))
    plan = pin(plan, "mix-plan")

    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_rows))
    # keys are about exponential with the mean weight as rate, so this spreads them evenly
    bucket = F.least(
        buckets - 1, F.floor(buckets * (1 - F.exp(-F.col("key") * F.col("mean_weight"))))
    ).cast("long")
    side = plan.select(F.col("source").alias("of"), "docs", "mean_weight", "rest")
    placed = draws.join(side, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket)
    totals = placed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    until = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    ends = (
        totals.withColumn("start", until - F.col("words"))
        .where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest")))
        .groupBy(F.col("source").alias("end_source"))
        .agg(F.min_by("bucket", "start").alias("end_bucket"), F.min("start").alias("start"))
    )
    last = placed.join(
        ends,
        F.col("source").eqNullSafe(F.col("end_source")) & (F.col("bucket") == F.col("end_bucket")),
    ).withColumn("draw", _order())
    before = F.sum("size").over(
        W.partitionBy("source").orderBy("draw").rowsBetween(W.unboundedPreceding, 0)
    ) - F.col("size")
    # a document belongs to the fraction if its middle does, so the budget is met to half a document
    middle = F.col("start") + F.col("before") + F.col("size") / 2
    inside = last.withColumn("before", before).where(middle < F.col("rest"))
    cuts = inside.groupBy(F.col("source").alias("cut_source")).agg(F.max("draw").alias("inner_cut"))
    # a bucket whose first document already lies beyond the budget: all earlier buckets are taken
    joined = (
        plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
        .withColumn("buckets", buckets)
    )
    return pin(
        joined.select("source", "total", "target", "full", "rest", "mean_weight", "buckets", "end_bucket", "inner_cut"),
        "mix-cuts",
    )


def _taken(draws: DataFrame, plan: DataFrame) -> DataFrame:
    own = plan.withColumnRenamed("source", "of")
    rows = draws.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bucket = F.least(
        F.col("buckets") - 1, F.floor(F.col("buckets") * (1 - F.exp(-F.col("key") * F.col("mean_weight"))))
    ).cast("long")
    earlier = bucket < F.col("end_bucket")
    extra = (F.col("rest") > 0) & (earlier | F.coalesce(_order() <= F.col("inner_cut"), F.lit(False)))
    repeats = F.col("full") + F.coalesce(extra, F.lit(False)).cast("int")
    return rows.withColumn("repeats", repeats).drop(
        "full", "rest", "mean_weight", "buckets", "end_bucket", "inner_cut"
    )


def mix_sources(
    documents: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    epochs: int = 3,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats), one row for every document.

    ``size`` counts words (a null text has none), ``target`` is the words a source shall give,
    ``repeats`` how often the mix takes the document, ``taken`` the words it so takes. A null source
    is a source of its own, after all others. Documents without words cost nothing and repeat like
    their source. Rows that share an id, null or not, draw each on its own; of equal rows a part may be
    taken once more, any of them. An empty table gives an empty result; other columns are not read.
    """
    draws = _draws(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
    draws = pin(draws.drop("text"), "draws")
    draws = pin(_keyed(draws, _repeated_ids(draws), seed), "keyed")
    plan = plan_mix(draws, weights=weights, share=share, epochs=epochs, bucket_rows=bucket_rows)
    return _taken(draws, plan).select(
        "doc_id",
        "source",
        "size",
        F.col("total").alias("source_size"),
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        "repeats",
    )


def mixed_documents(
    documents: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    epochs: int = 3,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The mix itself: every document as often as ``mix_sources`` takes it, with its own columns.

    Nulls, empty texts, repeated ids and rows count as they do there; of equal rows the same number is
    taken. Columns of any name stay as they are. An empty table gives an empty result.
    """
    rows = documents.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    slim = pin(_draws(rows.drop("document")).drop("text"), "draws")
    repeated = _repeated_ids(slim)
    keyed = pin(_keyed(slim, repeated, seed), "keyed")
    plan = plan_mix(keyed, weights=weights, share=share, epochs=epochs, bucket_rows=bucket_rows)
    taken = _taken(_keyed(_draws(rows).drop("text"), repeated, seed), plan)
    return (
        taken.where("repeats > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .select("document.*")
    )
