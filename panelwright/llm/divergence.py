"""How the sources of each language differ in their words: counts in Arrow, divergences from columnar shards.

Every task lower-cases, splits and dictionary-encodes its texts with Arrow's compute functions and counts
terms by hash grouping, so only partial counts are shuffled. The merged counts of a language are cut into
shards of whole terms; a shard holds a column of counts for every source, compares all sources on its terms
and sends one partial sum for each pair. Sums of whole numbers do not depend on the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.scratch import pin

#: What stands between terms: everything in ASCII but letters.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole numbers, in parts of this.
UNIT = 1_000_000_000
#: Distinct counts that a task holds before it sends them on.
HELD = 150_000
#: Rows of merged counts in a shard, about.
SHARD_ROWS = 100_000
#: Cells of a shard that are compared at once.
CELLS = 1_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
_KEY = ["lang", "source", "term"]


def _counted(part: pa.RecordBatch) -> pa.Table:
    """Occurrences of each (lang, source, term) of some texts, and in how many of them it stands.

    Each (lang, source) also has a row with a null term, so that sources without terms are known.
    """
    names = {k: pc.fill_null(part.column(k), "") for k in ("lang", "source")}
    pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("text"), "")), BETWEEN_TERMS)
    doc, term = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    filled = pc.not_equal(term, "")
    doc, term = doc.filter(filled), term.filter(filled).dictionary_encode()
    per_doc = pa.table({"doc": doc, "code": term.indices}).group_by(["doc", "code"], use_threads=False)
    per_doc = per_doc.aggregate([([], "count_all")])
    codes = {k: column.dictionary_encode() for k, column in names.items()}
    keys = {k: column.indices.take(per_doc["doc"]) for k, column in codes.items()}
    keys["term"] = per_doc["code"]
    found = pa.table(keys | {"n": per_doc["count_all"]}).group_by(_KEY, use_threads=False)
    found = found.aggregate([("n", "sum"), ("n", "count")])
    words = {k: column.dictionary.take(found[k]) for k, column in codes.items()}
    words["term"] = term.dictionary.take(found["term"])
    rows = pa.table(words | {"n": found["n_sum"], "docs": found["n_count"]})
    seen = pa.table(names).group_by(["lang", "source"], use_threads=False).aggregate([])
    blank = pa.nulls(seen.num_rows)
    zero = pa.array(np.zeros(seen.num_rows, np.int64))
    seen = pa.table({"lang": seen["lang"], "source": seen["source"], "term": blank.cast(pa.string()), "n": zero, "docs": zero})
    return pa.concat_tables([rows.cast(seen.schema), seen])


def _merged(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(_KEY, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select([*_KEY, "n_sum", "docs_sum"]).rename_columns([*_KEY, "n", "docs"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, new, waiting = [], [], 0
    for batch in batches:
        for part in tokens.chunks(batch):
            new.append(_counted(part))
            waiting += new[-1].num_rows
            if waiting >= HELD:
                held, new, waiting = [_merged(held + new)], [], 0
                if held[0].num_rows >= HELD:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                    held = []
    if held or new:
        yield from _merged(held + new).combine_chunks().to_batches(max_chunksize=50_000)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact for any long count."""
    top = (count.cast("decimal(19,0)") + 2) * F.lit(UNIT).cast("decimal(10,0)")
    bottom = total.cast("decimal(19,0)") + 2 * terms.cast("decimal(18,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, bottom)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so nothing passes 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _blocks(size: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    for first in range(0, size, step):
        yield slice(first, min(size, first + step))


def _compared(key: tuple[pa.Scalar, ...], counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Partial sums of the gaps between all sources of a language, on the terms of one shard."""
    base = sources["base"].to_numpy()
    n = len(base)
    row = {s: k for k, s in enumerate(sources["source"].to_pylist())}
    who = counts["source"].combine_chunks().dictionary_encode()
    at = np.array([row[s] for s in who.dictionary.to_pylist()], np.int64)[who.indices.to_numpy()]
    term = counts["term"].combine_chunks().dictionary_encode()
    code, p = term.indices.to_numpy(), counts["p"].to_numpy()
    order = np.argsort(code, kind="stable")
    code, at, p = code[order], at[order], p[order]
    total = np.zeros((n, n), np.int64)
    for terms in _blocks(len(term.dictionary), n):
        some = slice(*np.searchsorted(code, [terms.start, terms.stop]))
        shares = np.repeat(base[:, None], terms.stop - terms.start, axis=1)
        shares[at[some], code[some] - terms.start] = p[some]
        for a in range(n - 1):
            other = shares[a + 1 :]
            apart = other - shares[a]
            total[a, a + 1 :] += (apart * apart // (other + shares[a])).sum(axis=1)
    total += total.T
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    names = sources["source"].combine_chunks()
    return pa.table(
        {
            "lang": pa.repeat(key[0], len(a)),
            "source": names.take(pa.array(a)),
            "item": names.take(pa.array(b)),
            "value": total[a, b],
        }
    )


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of a corpus: occurrences, and documents that hold the term.

    Sources without terms have one row with a null term. Nulls count as empty text, language or source.
    """
    columns = [F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]
    partial_counts = documents.select(*columns).mapInArrow(_partial_counts, COUNTS)
    return partial_counts.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(documents: DataFrame, *, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from its language and its peers.

    A term is a run of ASCII letters, lower-cased, and non-ASCII characters. A language keeps the terms that
    stand in at least ``least_docs`` of its documents, V of them. A kept term's share is
    ``p = 1 + floor(1e9 * (count + 2) / (N + 2 * V))``, in a source as in the whole language, N being the
    occurrences of all kept terms there; two shares are ``floor((p - q)^2 / (p + q))`` apart.

    Part ``pair``: ``item`` is another source of the language and ``value`` the sum over all kept terms (0 if
    there are none); a source alone in its language has no such rows. Part ``term``: ``item`` is a kept term
    that stands in the source with a larger share than in the language, to rank ``top_terms``. Ranks count
    from 1 by value descending, then by the UTF-8 bytes of the item.

    Null text, language or source count as empty ones; empty texts have no terms, but their source counts.
    Repeated rows count as often as they stand there. Other columns, whatever their names, are not read. An
    empty table gives an empty result. A shard's memory grows with the square of the sources of a language,
    as the result itself does; it does not grow with terms or documents.
    """
    counts = pin(term_counts(documents), "counts")
    found = counts.where("term IS NOT NULL")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = pin(kept.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = pin(found.select(*_KEY, "n").join(kept, ["lang", "term"]), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    sources = (
        counts.select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left")
        .na.fill(0, ["total", "rows"])
        .join(languages, "lang", "left")
    )
    sources = pin(sources, "sources")

    shares = found.join(sources.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).select(
        *_KEY,
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    shares = pin(shares, "shares")
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")
    )
    pairs = _pairs(shares, sources).withColumn("part", F.lit("pair"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(by).alias("rank")
    terms = terms.select("*", rank).where(F.col("rank") <= top_terms)
    return terms.unionByName(pairs.select("*", rank))


def _pairs(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    shards = sources.groupBy("lang").agg((F.floor(F.sum("rows") / SHARD_ROWS) + 1).alias("shards"))
    base = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))
    dealt = (
        sources.join(shards, "lang")
        .select("lang", "source", F.coalesce(base, F.lit(1)).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    )
    own = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    sharded = shares.join(shards, "lang").select("lang", own, "source", "term", "p")
    sums = sharded.groupBy("lang", "shard").cogroup(dealt.groupBy("lang", "shard")).applyInArrow(
        _compared, "lang string, source string, item string, value long"
    )
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
