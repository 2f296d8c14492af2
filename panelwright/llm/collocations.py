"""Collocations by best-first growth of phrases, level by level over the whole corpus.

A phrase can be counted only by a pass over all texts, so growth goes in passes. Words are counted first,
then the pairs of frequent words, with exact scores. Three words are grown from pairs, best first: a round
sets each language a floor, and counts what may still matter above it. From the counts of its two pairs a
phrase of three has an admissible bound: it stands at most as often as the rarer pair, so its score is at
most that of a phrase that does. A round grows phrases whose bound reaches the floor, and all that may
swallow a pair whose score does. Then every score from the floor up is final. A language with enough of
them is settled, ties included; the others go on with a lower floor, at last with none.

What is grown reaches the tasks as flags in a table of fixed size, addressed by hashes of pairs. Pairs that
share an address share their flags, so a task may count more than it must, never less; exact counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.scratch import pin

#: Texts of about this many bytes are counted together.
CHUNK_BYTES = 500_000
#: Entries of the flag table (a power of two), one byte each, and entries that travel in one row.
ENTRIES, BLOCK = 1 << 22, 1 << 13
#: The first floor lets this many times the wanted phrases pass; each later one this many times more.
FIRST, WIDER = 2, 8
#: Parts of a language that are ranked apart before the best of them meet.
PARTS = 64

LIVE, CONTESTED, OPEN_LEFT, OPEN_RIGHT = 1, 2, 4, 8

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _ENDS.copy()
_GAP[[0x20, 0x09]] = True
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True

PHRASES = "lang string, phrase string, n long"


def _address(hashes: np.ndarray, ptr: np.ndarray, lang: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases of a length with their language, and where each text's begin."""
    raw, off = tokens.utf8(lang)
    own = tokens.mix(tokens.span_hash(raw, off[:-1], off[1:]), 11)
    phrase, out = tokens.window_hash(hashes, ptr, length)
    return tokens.mix(phrase ^ np.repeat(own, np.diff(out)), length), out


def _at(hashes: np.ndarray, entries: int) -> np.ndarray:
    return (hashes & np.uint64(entries - 1)).astype(np.int64)


def _grown(flags: np.ndarray, keys: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Which phrases are to be counted, by the flags of their first and last part (one word shorter)."""
    part = flags[_at(keys, len(flags))]
    last = np.zeros(len(part), bool)
    last[ptr[1:][np.diff(ptr) > 0] - 1] = True
    first = np.flatnonzero(~last)
    a, b = part[first], part[first + 1]
    live = (a & b & LIVE) != 0
    return live & (((a | b) & CONTESTED != 0) | ((a & OPEN_LEFT != 0) & (b & OPEN_RIGHT != 0)))


def _phrases(batches: Iterator[pa.RecordBatch], length: int, flags) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one length, for some texts at a time."""
    for batch in batches:
        for part in tokens.chunks(batch, size=CHUNK_BYTES):
            raw, off = tokens.utf8(part.column("text"))
            found = tokens.split(tokens.LOWER[raw], off, _GAP)
            if not len(found.start):
                continue
            hashes = tokens.word_hash(found)
            keys, ptr = _address(hashes, found.ptr, part.column("lang"), length)
            doc = np.repeat(np.arange(part.num_rows), np.diff(ptr))
            first = np.arange(len(keys)) + (found.ptr[:-1] - ptr[:-1])[doc]
            wanted = np.ones(len(keys), bool)
            if length > 1:
                piece = np.cumsum(_ENDS[raw], dtype=np.int32)[found.start]
                wanted &= piece[first] == piece[first + length - 1]
                shorter, shorter_ptr = _address(hashes, found.ptr, part.column("lang"), length - 1)
                wanted &= _grown(flags.value, shorter, shorter_ptr)
            keys, doc, first = keys[wanted], doc[wanted], first[wanted]
            _, one, n = np.unique(keys, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(doc[one])), _joined(found, first[one], length), pa.array(n)],
                ["lang", "phrase", "n"],
            )


def _joined(found: tokens.Words, first: np.ndarray, length: int) -> pa.Array:
    """The words from the given ones on, with one blank between them."""
    used = np.unique((first[:, None] + np.arange(length)).ravel())
    size = found.end[used] - found.start[used]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = found.raw[np.arange(off[-1]) + np.repeat(found.start[used] - off[:-1], size)]
    words = pa.Array.from_buffers(pa.large_string(), len(used), [None, pa.py_buffer(off), pa.py_buffer(data)])
    at = np.searchsorted(used, first)
    columns = [words.take(pa.array(at + k)) for k in range(length)]
    whole = columns[0] if length == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
    return whole.cast(pa.string())


def _flagged(batches: Iterator[pa.RecordBatch], length: int, entries: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the flag table that some phrases of one length give."""
    table = np.zeros(entries, np.uint8)
    for batch in batches:
        raw, off = tokens.utf8(batch.column("phrase"))
        found = tokens.split(raw, off, _BLANK)
        keys, _ = _address(tokens.word_hash(found), found.ptr, batch.column("lang"), length)
        np.bitwise_or.at(table, _at(keys, entries), batch.column("flags").to_numpy().astype(np.uint8))
    blocks = table.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array([blocks[k].tobytes() for k in some.tolist()], pa.binary())], ["block", "flags"]
    )


def _united(blocks: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in blocks["flags"]]
    whole = np.bitwise_or.reduce(rows)
    return pa.table({"block": blocks["block"][:1], "flags": pa.array([whole.tobytes()], pa.binary())})


def _flag_table(phrases: DataFrame, length: int, entries: int):
    """The flags of all ``phrases`` (lang, phrase, flags) as a broadcast table of ``entries`` bytes."""
    entries = max(entries, BLOCK)
    spread = partial(_flagged, length=length, entries=entries)
    blocks = phrases.mapInArrow(spread, "block long, flags binary")
    rows = blocks.groupBy("block").applyInArrow(_united, "block long, flags binary").collect()
    table = np.zeros((entries // BLOCK, BLOCK), np.uint8)
    for row in rows:
        table[row.block] = np.frombuffer(row.flags, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _counts(texts: DataFrame, length: int, flags=None) -> DataFrame:
    counted = texts.mapInArrow(partial(_phrases, length=length, flags=flags), PHRASES)
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _whole(x: Column) -> Column:
    return x.cast("decimal(14,0)")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals, exact for counts below 10^14."""
    top = _whole(a) * _whole(a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, _whole(left) * _whole(right))


def _share(a: Column, whole: Column) -> Column:
    """The most that a part with count ``a`` of something counted ``whole`` lets a phrase score."""
    return F.call_function("div", _whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), _whole(whole))


def _pairs(texts: DataFrame, words: DataFrame, least: int, entries: int) -> DataFrame:
    """All frequent pairs with their words' counts and their scores."""
    frequent = words.where(F.col("n") >= least)
    live = frequent.select("lang", "phrase", F.lit(LIVE | CONTESTED).alias("flags"))
    pairs = pin(_counts(texts, 2, _flag_table(live, 1, entries)).where(F.col("n") >= least), "pairs")
    word = F.split("phrase", " ")
    pairs = pairs.select("lang", "phrase", F.col("n").alias("a"), word[0].alias("first"), word[1].alias("second"))
    for name, count in (("first", "l"), ("second", "r")):
        pairs = pairs.join(frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(count)), ["lang", name])
    return pin(pairs.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))), "scored-pairs")


def _triples(texts: DataFrame, pairs: DataFrame, floors: DataFrame, least: int, entries: int) -> DataFrame:
    """Phrases of three that may reach their language's floor, or swallow a pair that does, with exact scores."""
    a, floor = F.col("a"), F.col("floor")
    flag = lambda condition, value: F.when(condition, value).otherwise(0)
    flags = (
        flag(F.col("score") >= floor, CONTESTED)
        + flag(_share(a, F.col("l")) >= floor, OPEN_LEFT)
        + flag(_share(a, F.col("r")) >= floor, OPEN_RIGHT)
        + LIVE
    )
    table = _flag_table(pairs.join(floors, "lang").select("lang", "phrase", flags.alias("flags")), 2, entries)
    texts = texts.join(floors.select("lang"), "lang", "left_semi").select("text", "lang")
    grown = pin(_counts(texts, 3, table).where(F.col("n") >= least), "triples")
    word = F.split("phrase", " ")
    grown = grown.select(
        "lang",
        "phrase",
        F.col("n").alias("a"),
        F.concat_ws(" ", word[0], word[1]).alias("head"),
        F.concat_ws(" ", word[1], word[2]).alias("tail"),
    )
    heads = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("head_n"), F.col("l").alias("first_n"))
    tails = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("tail_n"), F.col("r").alias("last_n"))
    cuts = F.array_sort(
        F.array(
            F.struct(_score(a, F.col("first_n"), F.col("tail_n")).alias("score"), F.lit(1).alias("k"), F.col("first_n").alias("l"), F.col("tail_n").alias("r")),
            F.struct(_score(a, F.col("head_n"), F.col("last_n")).alias("score"), F.lit(2).alias("k"), F.col("head_n").alias("l"), F.col("last_n").alias("r")),
        )
    )
    both = grown.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("cut", cuts[0])
    return both.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "head", "head_n", "tail", "tail_n")


def collocations(
    documents: DataFrame, *, limit: int = 2000, least: int = 10, swallowed: int = 50, entries: int = ENTRIES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks
    and tabs; n is a language's words. A candidate stands ``a >= least`` times inside pieces. Cut after its
    first words it has the parts' counts l and r and the score ``floor(1000000 * a * a / (l * r))``; its
    lowest cut counts, on ties the first. A pair inside a candidate of three that stands at least
    ``swallowed`` per cent as often is dropped. The first ``limit`` phrases go by score, then a, both
    descending, then by the phrase's UTF-8 bytes. Counts are exact below 10^14.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they
    stand there; a language without candidates has no rows. Other columns, whatever their names, are not
    read. An empty table gives an empty result. ``entries`` is the size of the broadcast flag table in bytes
    (a power of two), whatever the corpus; a smaller one only counts more phrases.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = documents.select(F.col("text").cast("string").alias("text"), lang.alias("lang")).where("text IS NOT NULL")
    words = pin(_counts(texts, 1), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = _pairs(texts, words, least, entries)

    settled, wanted = None, limit * FIRST
    waiting = pairs.select("lang").distinct()
    while True:
        floors = pin(_floors(pairs.join(waiting, "lang", "left_semi"), wanted), "floors")
        triples = pin(_triples(texts, pairs, floors, least, entries), "scored-triples")
        swallow = [
            triples.where(F.col("a") * 100 >= F.col(f"{part}_n") * swallowed).select("lang", F.col(part).alias("phrase"))
            for part in ("head", "tail")
        ]
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        left = pairs.select(columns).join(swallow[0].unionByName(swallow[1]), ["lang", "phrase"], "left_anti")
        final = left.unionByName(triples.select(columns)).join(floors, "lang").where("score >= floor")
        ranked = pin(_first(final, limit), "ranked")
        found = ranked.groupBy("lang").agg(F.count("*").alias("found"))
        state = floors.join(found, "lang", "left")
        done = F.coalesce(F.col("found"), F.lit(0)) >= limit
        enough = state.where(done | (F.col("floor") <= 0)).select("lang")
        part = ranked.drop("floor").join(enough, "lang", "left_semi")
        settled = part if settled is None else settled.unionByName(part)
        waiting = pin(state.join(enough, "lang", "left_anti").select("lang"), "waiting")
        if waiting.isEmpty():
            break
        wanted *= WIDER
    return settled.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _floors(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, floor): the score that so many pairs of a language reach, or 0 if it has fewer.

    Scores are whole numbers to a million, so a language has a bounded number of them.
    """
    scores = pairs.groupBy("lang", "score").agg(F.count("*").alias("phrases"))
    reached = F.sum("phrases").over(W.partitionBy("lang").orderBy(F.desc("score")))
    floor = F.coalesce(F.max(F.when(F.col("reached") >= wanted, F.col("score"))), F.lit(0))
    return scores.select("lang", "score", reached.alias("reached")).groupBy("lang").agg(floor.cast("long").alias("floor"))


def _first(phrases: DataFrame, limit: int) -> DataFrame:
    """The best phrases of each language with their ranks: the best of each part, then of all parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    for key in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*key).orderBy(*order)).alias("rank")
        own = [part] if "part" in key else []
        phrases = phrases.select("*", *own).select("*", rank).where(F.col("rank") <= limit)
        phrases = phrases.drop("rank", "part") if own else phrases
    return phrases
