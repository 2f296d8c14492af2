"""Toxicity of documents: boosted trees over dense features, with isotonic calibration.

The lexicon is a short fixed list and what labelled documents teach: words, and beginnings of words,
that are far more frequent in toxic ones. Features are counts and densities of both, how near they
stand to a second person, capitals, punctuation and disguised spelling. All features are computed on
whole texts from byte buffers.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.llm.trees import Forest, Isotonic, fit_boosted, fit_isotonic, folds, out_of_fold
from panelwright.scratch import pin

# Common insults, and pronouns of the second person in four languages.
INSULTS = (
    "asshole bastard bitch clown coward creep crap cretin cunt damn degenerate disgusting dumb dumbass "
    "fool freak fucker fucking garbage hate idiot idiotic imbecile jerk kill loser lunatic moron "
    "moronic pathetic pig pervert rat retard scum scumbag shit shitty slut stupid trash ugly vermin "
    "whore worthless arschloch dummkopf trottel idiota imbécil estúpido basura connard crétin débile salaud"
)
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros"
)
#: Labelled documents that a model learns from, at most, by the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: Units that a learned lexicon holds, at most, by their evidence.
LEXICON_UNITS = 2_000
#: Bytes of a word that make a unit of their own; 0 stands for the whole word.
UNIT_BYTES = (0, 5, 7)
#: Words between an insult and a second person that count as near.
NEAR = 6
THRESHOLD = 0.7

_GAP = tokens.IS_SPACE.copy()
_GAP[[ord(c) for c in string.punctuation]] = True
# Marks that stand for letters in disguised spelling.
_PLAIN = tokens.LOWER.copy()
for _mark, _letter in zip("013457@$", "oieastas", strict=True):
    _PLAIN[ord(_mark)] = ord(_letter)
_PLAIN_GAP = _GAP.copy()
_PLAIN_GAP[[ord("@"), ord("$")]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in string.punctuation]] = True
_ODD = _MARK.copy()
_ODD[48:58] = True

FEATURES = (
    "log_words insults insult_density learned learned_density learned_weight learned_top starts "
    "starts_density starts_top distinct near_you near_you_density capitals shouts marks disguised "
    "disguised_insults"
).split()


def _hash_list(words: str) -> np.ndarray:
    column = pa.array([words])
    return np.unique(tokens.word_hash(tokens.words_of(column)))


@dataclass
class Lexicon:
    """Hashed units with their weights, behind a table of 16-bit prefixes that rules most words out."""

    keys: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        self.maybe = np.zeros(65536, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Weight of every hash, 0 where the lexicon lacks it."""
        out = np.zeros(len(h))
        if not len(self.keys):
            return out
        some = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        found = self.keys[slot] == h[some]
        out[some[found]] = self.weights[slot[found]]
        return out


_INSULTS = _hash_list(INSULTS)
_YOU = _hash_list(SECOND_PERSON)


def _units(raw: np.ndarray, words: tokens.Words) -> list[np.ndarray]:
    """Hashes of all words, and of their beginnings of each length (0 where a word is shorter)."""
    spans = tokens.Spans(raw)
    out = []
    for n in UNIT_BYTES:
        if not n:
            out.append(spans(words.start, words.end))
            continue
        long = words.end - words.start >= n
        h = np.zeros(len(long), np.uint64)
        h[long] = tokens.mix(spans(words.start[long], words.start[long] + n), n)
        out.append(h)
    return out


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _tops(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return tokens.per_doc(np.maximum, values, ptr)


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` for every text; a null text counts as empty."""
    raw, off = tokens.utf8(column)
    if not len(raw):
        return np.zeros((len(off) - 1, len(FEATURES)))
    low = tokens.LOWER[raw]
    words = tokens.split(low, off, _GAP)
    ptr = words.ptr
    n = np.maximum(np.diff(ptr), 1)
    whole, *starts = _units(low, words)
    insults = Lexicon(_INSULTS, np.ones(len(_INSULTS))).look_up(whole)
    you = Lexicon(_YOU, np.ones(len(_YOU))).look_up(whole)
    learned = lexicon.look_up(whole)
    begun = np.max([lexicon.look_up(h) for h in starts], 0)
    hit = (insults > 0) | (learned > 0) | (begun > 0)
    near = np.zeros(len(hit))
    at, hits = np.flatnonzero(you), np.flatnonzero(hit)
    if len(at) and len(hits):
        doc = np.searchsorted(ptr, np.arange(len(hit)), "right") - 1
        right = np.searchsorted(at, hits)
        for side in (np.minimum(right, len(at) - 1), np.maximum(right - 1, 0)):
            close = (np.abs(at[side] - hits) <= NEAR) & (doc[at[side]] == doc[hits])
            near[hits[close]] = 1
    fresh = np.zeros(len(hit))
    if len(hits):
        doc = np.searchsorted(ptr, hits, "right") - 1
        _, first = np.unique(np.stack([doc.astype(np.uint64), whole[hits]]), axis=1, return_index=True)
        fresh[hits[first]] = 1
    letters = np.maximum(_sums(_LETTER[raw], off), 1)
    size = np.maximum(np.diff(off), 1)
    # words of letters with marks or digits between them
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = _ODD[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    plain_raw = _PLAIN[raw]
    plain = tokens.split(plain_raw, off, _PLAIN_GAP)
    unmasked = Lexicon(np.union1d(_INSULTS, lexicon.keys), np.ones(len(np.union1d(_INSULTS, lexicon.keys))))
    open_hits = _sums(unmasked.look_up(tokens.span_hash(plain_raw, plain.start, plain.end)) > 0, plain.ptr)
    own_hits = _sums((insults > 0) | (learned > 0), ptr)
    columns = [
        np.log1p(np.diff(ptr)),
        _sums(insults, ptr),
        _sums(insults, ptr) / n,
        _sums(learned > 0, ptr),
        _sums(learned > 0, ptr) / n,
        _sums(learned, ptr),
        _tops(learned, ptr),
        _sums(begun > 0, ptr),
        _sums(begun > 0, ptr) / n,
        _tops(begun, ptr),
        _sums(fresh, ptr),
        _sums(near, ptr),
        _sums(near, ptr) / n,
        _sums(_UPPER[raw], off) / letters,
        _sums(raw == ord("!"), off) / size,
        _sums(_MARK[raw], off) / size,
        _sums(inner, off) / size,
        np.maximum(open_hits - own_hits, 0),
    ]
    return np.stack(columns, 1)


def learn_lexicon(units: dict[str, np.ndarray], toxic: int, clean: int, limit: int = LEXICON_UNITS) -> Lexicon:
    """Units in at least three toxic documents that are over seven times as frequent there."""
    a, b = units["toxic"], units["clean"]
    rate_a, rate_b = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
    weight = np.log(rate_a / rate_b)
    keep = np.flatnonzero((a >= 3) & (weight > 2))
    order = keep[np.argsort(-(rate_a - rate_b)[keep] * weight[keep], kind="stable")][:limit]
    return Lexicon(units["key"][order], weight[order])


@dataclass
class Model:
    lexicon: Lexicon
    forest: Forest
    calibration: Isotonic

    def score(self, column: pa.Array) -> np.ndarray:
        return np.clip(self.calibration(self.forest.probability(features(column, self.lexicon))), 0, 1)


def id_remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(divisor))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, usable: Column) -> DataFrame:
    """(doc_id, y, text, nth): labelled documents of the ``rows`` smallest hashes of their ids.

    A document with several labels counts as positive if one of them is; labels without a value,
    and documents without an id, are not used. Of rows that repeat an id, the text with the smallest
    hash is used, so the sample has ``rows`` rows at most.
    """
    votes = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = pin(
        votes.where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .withColumn("nth", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int")),
        "picked",
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = texts.join(picked, "doc_id").groupBy("doc_id", "y", "nth")
    return pin(labelled.agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class and half that contain a unit, summed over each chunk."""
    for batch in batches:
        for part in tokens.chunks(batch):
            raw, off = tokens.utf8(part.column("text"))
            if not len(raw):
                continue
            low = tokens.LOWER[raw]
            words = tokens.split(low, off, _GAP)
            y, nth = part.column("y").to_numpy(), part.column("nth").to_numpy()
            doc = words.doc
            for h in _units(low, words):
                pair = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)
                key, owner = pair[0], pair[1].astype(np.int64)
                seen, slot = np.unique(key, return_inverse=True)
                sums = [
                    np.bincount(slot, (y[owner] == cls) & (nth[owner] == half), len(seen)).astype(np.int64)
                    for cls in (1, 0)
                    for half in (0, 1)
                ]
                keep = (seen != 0) & (sums[0] + sums[1] > 0)
                rest = (seen != 0) & ~keep
                for chosen in (keep, rest):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tokens.signed(seen[chosen]))] + [pa.array(s[chosen]) for s in sums],
                        ["key", "toxic_0", "toxic_1", "clean_0", "clean_1"],
                    )


def train(documents: DataFrame, labels: DataFrame, usable: Column, *, rows: int = TRAIN_ROWS) -> Model:
    """Learn the lexicon, trees and calibration from at most ``rows`` labelled documents.

    Trees see each document through a lexicon learned from the other half, and the calibration sees
    predictions of forests that were trained without the document.
    """
    sample = labelled_sample(documents, labels, "toxic", rows, usable)
    names = ["toxic_0", "toxic_1", "clean_0", "clean_1"]
    counted = (
        sample.mapInArrow(_count_units, "key long, toxic_0 long, toxic_1 long, clean_0 long, clean_1 long")
        .groupBy("key")
        .agg(*[F.sum(c).alias(c) for c in names])
        .where(F.col("toxic_0") + F.col("toxic_1") >= 3)
    )
    # only units that might enter a lexicon of this size come to the driver
    evidence = (F.col("toxic_0") + F.col("toxic_1")) - (F.col("clean_0") + F.col("clean_1")) / 7
    top = counted.where(evidence > 0).orderBy(F.desc(evidence), "key").limit(4 * LEXICON_UNITS)
    arrow = top.toArrow()
    columns = {c: arrow.column(c).to_numpy() for c in arrow.column_names}
    keys = columns["key"].view(np.uint64)
    sizes = {(r.y, r.nth): r.n for r in sample.groupBy("y", "nth").agg(F.count("*").alias("n")).collect()}

    def lexicon_of(halves: tuple[int, ...]) -> Lexicon:
        units = {
            "key": keys,
            "toxic": sum(columns[f"toxic_{h}"] for h in halves),
            "clean": sum(columns[f"clean_{h}"] for h in halves),
        }
        return learn_lexicon(
            units, sum(sizes.get((1, h), 0) for h in halves), sum(sizes.get((0, h), 0) for h in halves)
        )

    whole, other = lexicon_of((0, 1)), {0: lexicon_of((1,)), 1: lexicon_of((0,))}

    def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                nth = part.column("nth").to_numpy()
                x = np.where(
                    (nth == 0)[:, None], features(part.column("text"), other[0]), features(part.column("text"), other[1])
                )
                rows = pa.array(x.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), rows], ["doc_id", "y", "x"])

    seen = sample.mapInArrow(sample_features, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(seen.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = seen.column("y").to_numpy().astype(np.float64)
    calibration = fit_isotonic(out_of_fold(x, y), y)
    return Model(whole, fit_boosted(x, y), calibration)


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; a null or empty text is scored like one without words."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sent.value.score(part.column("text")))], ["doc_id", "score"]
                )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for every document.

    Labels are learned from documents whose crc32(doc_id) modulo 3 is not 1; ``held_out`` marks the
    others, and a null id is neither learned from nor held out. Language, source and id are no
    features. Null and empty texts are scored as texts without words; repeated rows score alike.
    Without labels, or with labels of one class, every score is the smoothed base rate. An empty
    table gives an empty result; other columns are not read.
    """
    model = train(documents, labels, id_remainder(3) != 1)
    return score_toxicity(documents, model).select(
        "doc_id",
        F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with their own columns, whatever their names.

    Null and empty texts are scored as texts without words; repeated rows score alike and go or stay
    together, null ids like any other. Without labels, or with labels of one class, every score is the
    smoothed base rate. An empty table gives an empty result.
    """
    model = train(documents, labels, F.lit(True))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                yield part.filter(pa.array(sent.value.score(part.column("text")) < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
