"""Quality rules: counts over whole documents, and boosted trees over them.

Trees are learned from labelled documents and kept as flat node arrays. They are monotone where a
larger value cannot make a text better: repeated lines, repeated three-word windows, symbols, words
without a letter, and capitals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.llm.toxicity import labelled_sample
from panelwright.llm.trees import Forest, fit_boosted

#: Labelled documents that the trees learn from, at most, by the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Chance of good quality from which a document is kept.
KEEP = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".!?,;:")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words word_length symbols_per_word dup_line_share repeat_share distinct_share wordless_share "
    "capitals points_per_word digits_per_char words_per_line lines"
).split()
#: Features that never raise the score (-1) as they grow.
MONOTONE = {
    FEATURES.index(name): -1
    for name in ("symbols_per_word", "dup_line_share", "repeat_share", "wordless_share", "capitals")
}


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _distinct_per_doc(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document."""
    merged = keys ^ tokens.mix(doc.astype(np.uint64), 11)
    _, first = np.unique(merged, return_index=True)
    return np.bincount(doc[first], minlength=n)


def document_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``COUNTS`` and ``FEATURES`` of every text; a null text counts as empty."""
    raw, off = tokens.utf8(column)
    n = len(off) - 1
    if not len(raw):
        return np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(FEATURES)))
    words = tokens.split(raw, off)
    ptr, doc = words.ptr, words.doc
    n_words = np.diff(ptr)
    spans = tokens.Spans(raw)
    points = (raw & 0xC0) != 0x80  # bytes that begin a code point
    word_chars = _sums(points & ~tokens.IS_SPACE[raw], off)
    n_symbols = _sums(_SYMBOL[raw], off)

    # lines: between line feeds and the ends of texts
    feeds = np.flatnonzero(raw == 10)
    line_start = np.union1d(off[:-1][off[:-1] < off[1:]], feeds + 1)
    line_start = line_start[line_start < len(raw)]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    after = np.searchsorted(feeds, line_start)
    next_feed = np.append(feeds, len(raw))[after]
    line_end = np.minimum(next_feed, off[line_doc + 1])
    worded = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_doc, line_start, line_end = line_doc[worded], line_start[worded], line_end[worded]
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup_lines = n_lines - _distinct_per_doc(spans(line_start, line_end), line_doc, n)

    h = spans(words.start, words.end) if len(words.start) else np.empty(0, np.uint64)
    windows, window_ptr = tokens.window_hash(h, ptr, 3)
    window_doc = np.repeat(np.arange(n), np.diff(window_ptr))
    _, slot, times = np.unique(
        windows ^ tokens.mix(window_doc.astype(np.uint64), 11), return_inverse=True, return_counts=True
    )
    again = times[slot] > 1
    first_word = np.arange(len(windows)) + (ptr[:-1] - window_ptr[:-1])[window_doc]
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[first_word[again] + k] = True
    n_repeat = _sums(repeated, ptr)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1)

    letters_before = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    wordless = letters_before[words.end] == letters_before[words.start]
    w, lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    letters = np.maximum(_sums(_LETTER[raw], off), 1)
    features = [
        np.log1p(n_words),
        word_chars / w,
        n_symbols / w,
        n_dup_lines / lines,
        n_repeat / w,
        _distinct_per_doc(h, doc, n) / w,
        _sums(wordless, ptr) / w,
        _sums(_UPPER[raw], off) / letters,
        _sums(_POINT[raw], off) / w,
        _sums(_DIGIT[raw], off) / np.maximum(np.diff(off), 1),
        n_words / lines,
        n_lines,
    ]
    return counts, np.stack(features, 1).astype(np.float64)


def train_quality(documents: DataFrame, labels: DataFrame, usable: Column, *, rows: int = TRAIN_ROWS) -> Forest:
    """Trees for the ``quality`` label from at most ``rows`` labelled documents."""
    sample = labelled_sample(documents, labels, "quality", rows, usable)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                x = pa.array(document_counts(part.column("text"))[1].tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), x], ["doc_id", "y", "x"])

    seen = sample.mapInArrow(measure, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(seen.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit_boosted(x, seen.column("y").to_numpy().astype(np.float64), monotone=MONOTONE)


def judge_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    Words are runs without white space; ``word_chars`` are their code points; ``n_symbols`` counts
    ``#*$%&|<>``; ``n_dup_lines`` are lines with a word that equal an earlier line of the text;
    ``n_repeat_words`` are words in three-word windows that the text holds twice or more. A document
    with under 50 words, or with over half of its words in repeated windows, fails the base rules;
    the others are kept if the trees give good quality a chance of one half. Null and empty texts have
    no words, so they fail. Repeated rows are judged alike, a null id like any other. Without labels
    the trees are a constant. An empty table gives an empty result; other columns are not read.
    """
    forest = train_quality(documents, labels, F.lit(True))
    sent = documents.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                counts, x = document_counts(part.column("text"))
                columns = [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                score = pa.array(sent.value.probability(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, score], ["doc_id", *COUNTS, "score"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= KEEP)).alias("kept"), "score"
    )
