"""Token ids of documents, packed into rows of fixed length by best-fit decreasing.

Documents are encoded with a public byte-level BPE vocabulary and closed by an end token. Those longer
than a row are cut into pieces without loss. Each task packs the pieces of its documents, longest
first, into the row whose remaining room is the smallest that suffices, which a segment tree over
capacities finds in logarithmic time. A packed row carries its ids as little-endian 16-bit words,
the cumulative lengths of its pieces, and the position at which each piece starts in its document:
positions restart at 0 with each document and run on for later pieces of a long one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelwright.llm import tokens

#: Pre-tokens of the vocabulary's public definition: contractions, letters, digits, other marks with
#: a leading blank each, then white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_TOKENS = 2048
#: Tokens that a task packs at a time.
GROUP_TOKENS = 2_000_000
#: Pieces whose ids a task remembers; when full it starts anew.
CACHE_PIECES = 1_000_000

# White space that is not ASCII's six characters joins pieces in ways the cache does not model;
# texts with one of these lead bytes are encoded as a whole.
_OTHER_SPACE = np.zeros(65536, bool)
for _lead, _seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
    for _second in _seconds:
        _OTHER_SPACE[_lead << 8 | _second] = True


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("packed", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encode many texts at once, each distinct piece of them only once.

    A piece is a word with the blank before it, or a stretch of white space; the vocabulary's
    pre-tokens never reach over the edge of one, so ids of pieces join to the ids of the text.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = encoding(ranks)
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint16)

    def learn(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.known) + len(keys) > CACHE_PIECES:
            self.forget()
        data = raw.tobytes()
        fresh = [self.bpe.encode_ordinary(data[a:b].decode()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        place = len(self.first) - 1 + np.arange(len(keys))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.array([x for ids in fresh for x in ids], np.uint16)])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.place = np.concatenate([self.place, place])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin; a null text has none."""
        raw, off = tokens.utf8(column)
        start, end, doc = _pieces(raw, off)
        keys, at, inverse = np.unique(tokens.span_hash(raw, start, end), return_index=True, return_inverse=True)
        for attempt in range(2):
            slot = np.searchsorted(self.known, keys)
            found = np.zeros(len(keys), bool)
            inside = slot < len(self.known)
            found[inside] = self.known[slot[inside]] == keys[inside]
            if found.all():
                break
            # the cache may have been emptied to make room, then all pieces are new
            new = at[~found]
            before = len(self.known)
            self.learn(keys[~found], raw, start[new], end[new])
            if before and len(self.known) < before + len(new) and attempt == 0:
                missing = ~np.isin(keys, self.known)
                self.learn(keys[missing], raw, start[at[missing]], end[at[missing]])
        slot = self.place[np.searchsorted(self.known, keys)][inverse]
        lengths = self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[slot] - total[:-1], lengths)]
        ptr = total[np.searchsorted(doc, np.arange(len(off)))]
        return self._exact(column, raw, off, ids, ptr)

    def _exact(
        self, column: pa.Array, raw: np.ndarray, off: np.ndarray, ids: np.ndarray, ptr: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        if len(raw) < 1:
            return ids, ptr
        pair = np.zeros(len(raw), bool)
        pair[:-1] = _OTHER_SPACE[raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]]
        pair |= (raw >= 0x1C) & (raw <= 0x1F)
        odd = np.unique(np.searchsorted(off, np.flatnonzero(pair), "right") - 1)
        if not len(odd):
            return ids, ptr
        whole = {int(d): np.array(self.bpe.encode_ordinary(column[int(d)].as_py()), np.uint16) for d in odd}
        parts = [whole.get(d, ids[ptr[d] : ptr[d + 1]]) for d in range(len(off) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _pieces(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every piece, in the order of the bytes."""
    words = tokens.split(raw, off)
    doc = words.doc
    head = off[:-1][doc] < words.start
    blank = head & (raw[np.maximum(words.start - 1, 0)] == 0x20)
    word_start = words.start - blank
    # white space before each word, without the blank that the word takes
    same = np.zeros(len(doc), bool)
    same[1:] = doc[1:] == doc[:-1]
    gap_start = np.where(same, np.concatenate([[0], words.end[:-1]]) if len(doc) else words.end, off[:-1][doc])
    cut = np.where(blank, word_start, np.maximum(words.start - 1, gap_start))
    lead = cut > gap_start  # all but the last character of the stretch
    single = ~blank & (words.start > gap_start)  # the last one, where it is no blank
    # white space that ends a text
    last = np.where(words.counts > 0, words.end[np.maximum(words.ptr[1:] - 1, 0)] if len(doc) else 0, off[:-1])
    tail = last < off[1:]
    start = np.concatenate([word_start, gap_start[lead], words.start[single] - 1, last[tail]])
    end = np.concatenate([words.end, cut[lead], words.start[single], off[1:][tail]])
    owner = np.concatenate([doc, doc[lead], doc[single], np.flatnonzero(tail)])
    order = np.argsort(start, kind="stable")
    return start[order], end[order], owner[order]


class Capacities:
    """Open rows by remaining room, as a segment tree of counts."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the fullest row that still has ``need`` tokens of room."""
        at = need + self.size
        count = self.count
        if not count[at]:
            # climb until a right sibling has rows, then go down to its smallest room
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, most: int) -> np.ndarray:
    """Row of each piece: longest first, each into the fullest row that has room for it."""
    row_of = np.empty(len(lengths), np.int64)
    open_rows = Capacities(most)
    rows = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = open_rows.take(need)
        if found is None:
            room, row = most, rows
            rows += 1
        else:
            room, row = found
        row_of[k] = row
        if room > need:
            open_rows.put(room - need, row)
    return row_of


SCHEMA = (
    "part int, row long, n_tokens int, doc_ids array<long>, cu_lengths array<int>, "
    "start_positions array<int>, token_ids binary"
)


def _pack(
    ids: np.ndarray, ptr: np.ndarray, docs: np.ndarray, nulls: np.ndarray, first_row: int, row_tokens: int, pad: int, part: int
) -> pa.RecordBatch:
    lengths = np.diff(ptr)
    pieces = -(-lengths // row_tokens)
    doc = np.repeat(np.arange(len(docs)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]).astype(np.int64), pieces)
    position = nth * row_tokens
    size = np.minimum(row_tokens, lengths[doc] - position)
    row = best_fit(size, row_tokens)
    order = np.argsort(row, kind="stable")
    row, doc, position, size = row[order], doc[order], position[order], size[order]
    rows = int(row[-1]) + 1 if len(row) else 0
    bounds = np.searchsorted(row, np.arange(rows + 1))
    filled = np.concatenate([[0], np.cumsum(size)])
    inside = filled[:-1] - filled[bounds[:-1]][row] if rows else filled[:0]
    matrix = np.full(rows * row_tokens, pad, "<u2")
    source = np.arange(filled[-1]) + np.repeat(ptr[:-1][doc] + position - filled[:-1], size)
    target = np.arange(filled[-1]) + np.repeat(row * row_tokens + inside - filled[:-1], size)
    matrix[target] = ids[source]
    used = np.diff(filled[bounds]) if rows else np.empty(0, np.int64)
    # cumulative lengths of each row, with the 0 in front
    cu = np.insert(inside + size, bounds[:-1], 0) if rows else np.empty(0, np.int64)
    offsets = pa.array(bounds.astype(np.int32))
    cu_offsets = pa.array((bounds + np.arange(rows + 1)).astype(np.int32))
    wide = np.arange(rows + 1, dtype=np.int32) * (2 * row_tokens)
    binary = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(wide), pa.py_buffer(matrix.tobytes())])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, part, np.int32)),
            pa.array(np.arange(first_row, first_row + rows)),
            pa.array(used.astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(docs[doc], mask=nulls[doc])),
            pa.ListArray.from_arrays(cu_offsets, pa.array(cu.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(position.astype(np.int32))),
            binary,
        ],
        ["part", "row", "n_tokens", "doc_ids", "cu_lengths", "start_positions", "token_ids"],
    )


def packed_rows(
    documents: DataFrame, vocabulary_path: str, *, row_tokens: int = ROW_TOKENS, end_token: int | None = None
) -> DataFrame:
    """Packed rows (part, row, n_tokens, doc_ids, cu_lengths, start_positions, token_ids).

    ``part`` and ``row`` name a row; ``token_ids`` is one row of the id matrix, ``row_tokens``
    unsigned 16-bit ids, of which the first ``n_tokens`` count and the rest repeat the end token.
    Piece k of a row belongs to ``doc_ids[k]``, spans ``cu_lengths[k]`` to ``cu_lengths[k + 1]`` and
    starts at position ``start_positions[k]`` of its document. Every document gives its ids and the
    end token (by default the id after the vocabulary), so an empty or null text gives one token; a
    null doc_id stays null; repeated rows are packed each. Other columns are not read. An empty
    table gives no rows. The vocabulary is read on the driver and sent along; its size is fixed.
    """
    ranks = read_vocabulary(vocabulary_path)
    end = max(ranks.values()) + 1 if end_token is None else end_token
    if end > 65535 or max(ranks.values()) > 65535:
        raise ValueError("ids must fit 16 bits")
    sent = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        part = TaskContext.get().partitionId()
        row = held = 0
        gathered: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in gathered])
            ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in gathered]))])
            docs = pa.concat_arrays([x[2] for x in gathered])
            nulls = docs.is_null().to_numpy(zero_copy_only=False)
            return _pack(ids, ptr, docs.fill_null(0).to_numpy(), nulls, row, row_tokens, end, part)

        for batch in batches:
            for piece in tokens.chunks(batch):
                ids, ptr = encoder.encode(piece.column("text"))
                closed = np.insert(ids, ptr[1:], end)
                gathered.append((closed, ptr + np.arange(len(ptr)), piece.column("doc_id")))
                held += len(closed)
                if held >= GROUP_TOKENS:
                    out = flush()
                    yield out
                    row, held, gathered = row + out.num_rows, 0, []
        if gathered:
            yield flush()

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(documents: DataFrame, vocabulary_path: str, path: str, **settings) -> None:
    """Write packed rows as Parquet below ``path``; a lost task writes its own rows again."""
    packed_rows(documents, vocabulary_path, **settings).write.parquet(path)


def position_ids(cu_lengths: list[int], start_positions: list[int]) -> list[int]:
    """Positions of a packed row's tokens, restarting where a document begins."""
    spans = zip(cu_lengths, cu_lengths[1:], start_positions, strict=False)
    return [start + k for a, b, start in spans for k in range(b - a)]
