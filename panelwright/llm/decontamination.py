"""Benchmark passages in training documents, found by spaced seeds.

A spaced seed is a window of words of which a fixed mask reads only some, so a hit survives words that
were substituted at the positions left out. Every window of every document is hashed under every
mask; hashes are first held against a bitmap of the benchmark's, of fixed size whatever the benchmark,
and the few that may match are joined with the benchmark's hashes. Around each hit the document and
the item are compared word by word along the diagonal of the hit.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.scratch import pin

#: Fixed masks: positions that are read, within windows of up to ten words.
MASKS = (
    (0, 1, 2, 3, 4, 5, 6),
    (0, 1, 3, 4, 6, 8, 9),
    (0, 2, 3, 5, 7, 8, 9),
    (0, 1, 2, 5, 6, 7, 9),
    (0, 1, 2, 4, 5, 6, 8),  # leaves out every fourth word
)
#: Items below this many words have masks of their own.
SHORT = max(mask[-1] for mask in MASKS) + 1
#: Words on which a passage must agree to count, unless the item is shorter.
ENOUGH = 13
#: Share of a short item's words that must agree.
SHARE = 0.75
#: What a differing word costs against one that agrees.
PENALTY = 2
#: The bitmap has this many bits and is read twice for a hash.
BITMAP_BITS = 26

_GAP = tokens.IS_SPACE.copy()
_GAP[[ord(c) for c in string.punctuation]] = True


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, and where each text's begin; punctuation parts words."""
    raw, off = tokens.utf8(column)
    words = tokens.split(tokens.LOWER[raw], off, _GAP)
    return tokens.word_hash(words), words.ptr


def _seeds(h: np.ndarray, ptr: np.ndarray, masks: tuple[tuple[int, ...], ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, key) of every window under every mask."""
    last = np.repeat(ptr[1:], np.diff(ptr))
    every = np.arange(len(h))
    for nth, mask in enumerate(masks):
        at = every[every + mask[-1] < last]
        total = np.zeros(len(at), np.uint64)
        for k, offset in enumerate(mask):
            total += h[at + offset] * np.uint64((2 * k + 3) ** 13 % 2**64 | 1)
        yield at, tokens.mix(total, 31 * len(mask) + nth)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = np.uint64(64 - BITMAP_BITS)
    return (keys >> width).astype(np.int64), (tokens.mix(keys, 7) >> width).astype(np.int64)


def masks_for(lengths: list[int]) -> tuple[tuple[int, ...], ...]:
    """The fixed masks, and those for items of the given lengths, if short.

    A short item counts from three quarters of its words on: these stand in one row, or in two rows of
    three or more around one differing word.
    """
    short = sorted(n for n in lengths if 0 < n < SHORT)
    rows = {tuple(range(int(np.ceil(SHARE * n)))) for n in short}
    around = {(0, 1, 2, 4, 5, 6)} if any(n >= 7 for n in short) else set()
    return MASKS + tuple(sorted((rows | around) - set(MASKS)))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, ptr = _words(batch.column("text"))
        words = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(tokens.signed(h)))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), words], ["item_id", "words"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy()
    values = column.values.to_numpy()[off[0] : off[-1]]
    return values.view(np.uint64), (off - off[0]).astype(np.int64)


def _best_segment(same: np.ndarray) -> tuple[int, int]:
    """First and past-last position of the segment with the most agreement after penalties."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    return int(np.argmin(score[: end + 1])), end


def contaminated_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_same, text_key): passages of items in documents.

    Words are lower-cased (A-Z) runs without white space or ASCII punctuation. A row says that the
    document's ``n_words`` words from ``first_word`` lie on the item with ``n_same`` equal words: at
    least 13, or three quarters of an item shorter than that, a differing word counting against two equal
    ones. Passages are found if one mask fits between their differing words: all that have seven equal
    words in a row or leave out every fourth word, items under ten words wherever they count, and most
    others with scattered differences (tests hold recall above 0.9 at every length). One row for each document row, item and
    diagonal. Null or empty texts and items hold nothing; null ids are reported as null, and
    ``text_key`` tells documents without one apart; repeated rows are reported each; the benchmark may repeat
    items. Other columns are not read. Without items or documents the result is empty.
    """
    items = pin(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
            _item_words, "item_id long, words array<long>"
        ).withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    lengths = items.where(F.size("words").between(1, SHORT - 1)).select(F.size("words").alias("n")).distinct()
    masks = masks_for([row.n for row in lengths.collect()])  # fewer than ``SHORT`` numbers

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ptr = _flat(batch.column("words"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ptr))
            names = batch.column("item").to_numpy()
            for at, key in _seeds(h, ptr, masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[owner[at]]), pa.array(at - ptr[owner[at]]), pa.array(tokens.signed(key))],
                    ["item", "at", "key"],
                )

    seeds = pin(items.select("item", "words").mapInArrow(item_seeds, "item long, at long, key long").distinct(), "seeds")

    def seed_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_slots(keys))))], ["slot"])

    bits = (
        seeds.select("key")
        .mapInArrow(seed_slots, "slot long")
        .groupBy(F.call_function("bitmap_bucket_number", F.col("slot") + 1).alias("bucket"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("slot") + 1)).alias("bits"))
    )
    # at most 2**BITMAP_BITS bits (8 MB), whatever the benchmark holds
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in bits.toLocalIterator():
        first = (row.bucket - 1) * 4096
        bitmap[first : first + 4096] = np.frombuffer(row.bits, np.uint8)
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        part = TaskContext.get().partitionId() << 36
        seen = 0

        def marked(slot: np.ndarray) -> np.ndarray:
            return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            for piece in tokens.chunks(batch):
                h, ptr = _words(piece.column("text"))
                ats, keys = [], []
                for at, key in _seeds(h, ptr, masks):
                    one, other = _slots(key)
                    some = np.flatnonzero(marked(one))
                    some = some[marked(other[some])]
                    ats.append(at[some])
                    keys.append(key[some])
                at, key = np.concatenate(ats), np.concatenate(keys)
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                bounds = np.searchsorted(at, ptr)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    n = np.diff(bounds)[some]
                    words = np.concatenate([h[ptr[d] : ptr[d + 1]] for d in some])
                    word_ptr = np.concatenate([[0], np.cumsum(np.diff(ptr)[some])]).astype(np.int32)
                    hit_ptr = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    local = at - np.repeat(ptr[some], n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part + seen + some),
                            piece.column("doc_id").take(pa.array(some)),
                            piece.column("text_key").take(pa.array(some)),
                            pa.ListArray.from_arrays(pa.array(word_ptr), pa.array(tokens.signed(words))),
                            pa.ListArray.from_arrays(pa.array(hit_ptr), pa.array(local)),
                            pa.ListArray.from_arrays(pa.array(hit_ptr), pa.array(tokens.signed(key))),
                        ],
                        ["row", "doc_id", "text_key", "words", "at", "key"],
                    )
                seen += piece.num_rows

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    suspect = pin(
        texts.mapInArrow(
            suspects,
            "row long, doc_id long, text_key long, words array<long>, at array<long>, key array<long>",
        ),
        "suspects",
    )
    hits = (
        suspect.select("row", F.explode(F.arrays_zip("at", "key")).alias("hit"))
        .select("row", F.col("hit.at").alias("doc_at"), F.col("hit.key").alias("key"))
        .join(seeds, "key")
        .select("row", "item", (F.col("doc_at") - F.col("at")).alias("diagonal"))
        .distinct()
    )
    pairs = (
        suspect.select("row", "doc_id", "text_key", F.col("words").alias("doc_words"))
        .join(hits, "row")
        .join(items.withColumnRenamed("words", "item_words"), "item")
    )
    checked = pairs.mapInArrow(
        _verify, "doc_id long, text_key long, item_id long, first_word long, n_words long, n_same long"
    )
    return checked.select("doc_id", "item_id", "first_word", "n_words", "n_same", "text_key")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, doc_ptr = _flat(batch.column("doc_words"))
        item, item_ptr = _flat(batch.column("item_words"))
        diagonals = batch.column("diagonal").to_pylist()
        keep, first, width, same = [], [], [], []
        for k, diagonal in enumerate(diagonals):
            d = doc[doc_ptr[k] : doc_ptr[k + 1]]
            i = item[item_ptr[k] : item_ptr[k + 1]]
            low, high = max(0, -diagonal), min(len(i), len(d) - diagonal)
            equal = d[low + diagonal : high + diagonal] == i[low:high]
            a, b = _best_segment(equal)
            n = int(equal[a:b].sum())
            if n >= min(ENOUGH, int(np.ceil(SHARE * len(i)))):
                keep.append(k)
                first.append(low + diagonal + a)
                width.append(b - a)
                same.append(n)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(at),
                batch.column("text_key").take(at),
                batch.column("item_id").take(at),
                pa.array(first, pa.int64()),
                pa.array(width, pa.int64()),
                pa.array(same, pa.int64()),
            ],
            ["doc_id", "text_key", "item_id", "first_word", "n_words", "n_same"],
        )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any passage of the benchmark, with their own columns, whatever their names.

    Null and empty texts hold nothing and stay. A row goes for its own text: rows that repeat an id, null
    or not, go or stay by theirs, and equal rows together. Without items all documents stay; an empty
    table gives an empty result.
    """
    found = contaminated_passages(documents, benchmark).select(
        F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")
    ).distinct()
    rows = documents.select(
        F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key")
    )
    same = F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_key") == F.col("found_key"))
    return rows.join(found, same, "left_anti").select("document.*")
