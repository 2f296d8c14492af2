"""Log probabilities of documents under an n-gram model in Elias-Fano tries.

Documents are cut into blocks of whole texts; a block keeps its distinct word hashes and its tokens
as numbers into them. Counting and scoring move the blocks' distinct words and word pairs to shards
by hash, once: a shard adds up the counts of all blocks, builds its part of the trie, answers each
block's pairs from the trie and sends back two bytes for each. So nothing is gathered in one place,
and what moves is distinct pairs of blocks, not tokens. A context that makes up a large share of all
tokens is dealt over all shards by its successors.

A pair's probability is its share of the context, discounted by ``strength`` unseen observations
that are spread like single words: ``(c(u, w) + s * p(w)) / (c(u) + s)``, where ``p(w)`` is the
add-one probability of the word. The trie holds the first part, quantised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.llm.elias_fano import NgramTrie, restore
from panelwright.llm.toxicity import id_remainder
from panelwright.scratch import pin

#: Tokens of a block, about; a block holds whole texts.
BLOCK_TOKENS = 1_000_000
#: Tokens of the corpus for each shard.
SHARD_TOKENS = 2_500_000
#: Unseen observations in each context.
STRENGTH = 50.0
#: A context is dealt by successors if it makes up this part of a shard's tokens.
HOT_PART = 1 / 16

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
BEGIN = U64(0x14057B7EF767814F)


def _press(values: np.ndarray) -> bytes:
    return np.int64(values.nbytes).tobytes() + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _open(data: bytes, kind: type) -> np.ndarray:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), kind)


BLOCK = "block long, n_tokens long, trained long, n_docs_trained long, docs binary, held binary, ptr binary, vocabulary binary, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    done = held_tokens = 0
    gathered: list[tuple] = []

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in gathered])
        counts = np.concatenate([x[1] for x in gathered])
        docs = pa.concat_arrays([x[2] for x in gathered])
        held = np.concatenate([x[3] for x in gathered])
        vocabulary, ids, times = np.unique(h, return_inverse=True, return_counts=True)
        # frequent words first: their small numbers compress well
        frequent = np.argsort(-times, kind="stable")
        rank = np.empty(len(frequent), np.uint32)
        rank[frequent] = np.arange(len(frequent))
        vocabulary, ids = vocabulary[frequent], rank[ids]
        ptr = np.concatenate([[0], np.cumsum(counts)])
        # null ids travel as a flag beside the number
        numbers = np.stack([docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)])
        values = [
            part + done,
            len(h),
            int(counts[~held].sum()),
            int((~held).sum()),
            _press(numbers.astype(np.int64)),
            _press(held),
            _press(ptr),
            _press(vocabulary),
            _press(ids),
        ]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

    for batch in batches:
        for piece in tokens.chunks(batch):
            words = tokens.words_of(piece.column("text"))
            h = np.insert(tokens.word_hash(words), words.ptr[1:], END)
            held = piece.column("held_out").to_numpy(zero_copy_only=False)
            gathered.append((h, words.counts + 1, piece.column("doc_id"), held))
            held_tokens += len(h)
            if held_tokens >= block_tokens:
                yield flush()
                done, held_tokens, gathered = done + 1, 0, []
    if gathered:
        yield flush()


class Block:
    """A block's arrays, and its distinct pairs in the order in which shards see them."""

    def __init__(self, row: dict):
        self.ptr = _open(row["ptr"], np.int64)
        self.held = _open(row["held"], bool)
        self.vocabulary = _open(row["vocabulary"], U64)  # by falling frequency
        self.ids = _open(row["ids"], np.uint32).astype(np.int64)
        self.trained = np.repeat(~self.held, np.diff(self.ptr))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.trained], minlength=len(self.vocabulary))

    def pairs(self, shards: int, hot: np.ndarray) -> tuple:
        """Distinct pairs by shard, context and successor; and which of them each token ends."""
        size = len(self.vocabulary)
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.ids[:-1]
        before[self.ptr[:-1][self.ptr[:-1] < len(before)]] = size  # a text's first word follows the start
        key, token_pair = np.unique(before * (size + 1) + self.ids, return_inverse=True)
        hashes = np.append(self.vocabulary, BEGIN)
        context, word = hashes[key // (size + 1)], hashes[key % (size + 1)]
        successor = (tokens.mix(word, 5) >> U64(32)).astype(np.uint32)
        dealt = np.where(np.isin(context, hot), tokens.mix(context ^ tokens.mix(word, 6), 6), tokens.mix(context, 6))
        shard = shard_of(dealt, shards)
        order = np.lexsort((successor, context, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return shard[order], context[order], successor[order], place[token_pair]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _slices(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[a]), int(a), int(b)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


_SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary()), ("counts", pa.binary())])
SENT = "shard long, block long, keys binary, runs binary, counts binary"
_ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("shard", pa.int64()), ("answer", pa.binary()), ("total", pa.int64()), ("types", pa.int64())])
ANSWER = "block long, level int, shard long, answer binary, total long, types long"


def _word_counts(table: pa.Table, least: float) -> pa.Table:
    """Add up the words of a shard; answer each block, and tell the shard's totals and hot words."""
    keys = [_open(k.as_py(), U64) for k in table.column("keys")]
    counts = [_open(c.as_py(), np.uint32) for c in table.column("counts")]
    known, slot = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(slot, np.concatenate(counts), len(known)).astype(np.int64)
    shard = table.column("shard")[0].as_py()
    cuts = np.cumsum([0] + [len(k) for k in keys])
    rows = [
        (block.as_py(), 1, shard, _press(total[slot[a:b]].astype(np.uint32)), 0, 0)
        for block, a, b in zip(table.column("block"), cuts, cuts[1:], strict=False)
    ]
    hot = np.flatnonzero(total >= least)
    pack = _press(np.stack([known[hot], total[hot].astype(U64)])) if len(hot) else None
    rows.append((-1, 1, shard, pack, int(total.sum()), int((total > 0).sum())))
    return pa.Table.from_batches([_rows(rows, _ANSWER)])


def _pair_answers(hot: np.ndarray, hot_counts: np.ndarray, strength: float):
    def run(table: pa.Table) -> pa.Table:
        contexts = [_open(k.as_py()[: int.from_bytes(k.as_py()[-8:], "little")], U64) for k in table.column("keys")]
        successors = [_open(k.as_py()[int.from_bytes(k.as_py()[-8:], "little") : -8], np.uint32) for k in table.column("keys")]
        runs = [_open(r.as_py(), np.uint32).astype(np.int64) for r in table.column("runs")]
        counts = [_open(c.as_py(), np.uint32) for c in table.column("counts")]
        context = np.concatenate([np.repeat(c, r) for c, r in zip(contexts, runs, strict=True)])
        successor, n = np.concatenate(successors), np.concatenate(counts)
        seen = n > 0
        context, successor, n = context[seen], successor[seen], n[seen].astype(np.float64)
        order = np.lexsort((successor, context))
        context, successor, n = context[order], successor[order], n[order]
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
        starts = np.flatnonzero(new)
        pair = np.add.reduceat(n, starts) if len(starts) else n
        context, successor = context[starts], successor[starts]
        head = np.ones(len(context), bool)
        head[1:] = context[1:] != context[:-1]
        owner = np.cumsum(head) - 1
        whole = np.bincount(owner, pair) if len(pair) else np.zeros(0)
        if len(hot) and len(context):
            first = context[head]
            slot = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
            spread = hot[slot] == first
            whole[spread] = hot_counts[slot[spread]]
        trie = NgramTrie(context, successor, pair / (whole[owner] + strength) if len(pair) else pair)
        shard = table.column("shard")[0].as_py()
        rows = [
            (block.as_py(), 2, shard, _press(trie.look_up(c, r, s)), 0, 0)
            for block, c, r, s in zip(table.column("block"), contexts, runs, successors, strict=True)
        ]
        return pa.Table.from_batches([_rows(rows, _ANSWER)])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score_documents(
    documents: DataFrame, *, strength: float = STRENGTH, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    The model learns from documents whose crc32(doc_id) modulo 7 is not 2, and from those with a null
    id. Tokens are lower-cased (A-Z) words and one end; a null text is an empty one and has the end
    alone. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)), ``score`` the model's log10
    probability. Repeated rows are scored, and learned from, each. An empty table gives an empty
    result; other columns are not read.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(id_remainder(7) == 2, F.lit(False)).alias("held_out"),
        "text",
    )
    blocks = pin(texts.mapInArrow(lambda rows: _blocks(rows, block_tokens), BLOCK), "blocks")
    sums = blocks.agg(F.sum("n_tokens"), F.sum("trained"), F.sum("n_docs_trained")).first()
    all_tokens, n, trained_docs = (int(x or 0) for x in sums)
    shards = max(1, -(-all_tokens // shard_tokens))
    # a context with this many tokens would fill a large part of one shard; there are few of them
    least = max(1.0, HOT_PART * n / shards)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_block(batches):
            block = Block(row)
            order = np.argsort(block.vocabulary)
            keys, counts = block.vocabulary[order], block.word_counts().astype(np.uint32)[order]
            none = _press(np.empty(0, np.uint32))
            yield _rows(
                [
                    (s, row["block"], _press(keys[a:b]), none, _press(counts[a:b]))
                    for s, a, b in _slices(shard_of(keys, shards))
                ],
                _SENT,
            )

    def count_words(rows: pa.Table) -> pa.Table:
        return _word_counts(rows, least)

    words = pin(blocks.mapInArrow(send_words, SENT).groupBy("shard").applyInArrow(count_words, ANSWER), "word-counts")
    v = int(words.where("block = -1").agg(F.sum("types")).first()[0] or 0)
    # at most 16 words for each shard are that frequent
    frequent = words.where("block = -1 AND answer IS NOT NULL").select("answer").collect()
    packs = [_open(r.answer, U64).reshape(2, -1) for r in frequent]
    hot = {int(k): int(c) for pack in packs for k, c in zip(pack[0], pack[1], strict=True)}
    hot.pop(int(END), None)
    hot[int(BEGIN)] = trained_docs
    hot_keys = np.array(sorted(hot), U64)
    hot_counts = np.array([hot[int(k)] for k in hot_keys], np.float64)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_block(batches):
            block = Block(row)
            shard, context, successor, of_token = block.pairs(shards, hot_keys)
            counts = np.bincount(of_token[block.trained], minlength=len(shard)).astype(np.uint32)
            rows = []
            for s, a, b in _slices(shard):
                own = context[a:b]
                starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                runs = np.diff(np.append(starts, b - a)).astype(np.uint32)
                head = _press(own[starts])
                keys = head + _press(successor[a:b]) + len(head).to_bytes(8, "little")
                rows.append((s, row["block"], keys, _press(runs), _press(counts[a:b])))
            yield _rows(rows, _SENT)

    pairs = (
        blocks.mapInArrow(send_pairs, SENT)
        .groupBy("shard")
        .applyInArrow(_pair_answers(hot_keys, hot_counts, strength), ANSWER)
    )
    answers = words.where("block >= 0").unionByName(pairs)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("level", "ascending"), ("shard", "ascending")])
        level = right.column("level").to_numpy()
        parts = [x.as_py() for x in right.column("answer")]
        sorted_counts = np.concatenate([_open(p, np.uint32) for p, k in zip(parts, level, strict=True) if k == 1])
        codes = np.concatenate([_open(p, np.uint16) for p, k in zip(parts, level, strict=True) if k == 2])
        row = {name: left.column(name)[0].as_py() for name in left.schema.names}
        block = Block(row)
        ids, ptr = block.ids, block.ptr
        counts = np.empty(len(sorted_counts), np.uint32)
        counts[np.argsort(block.vocabulary)] = sorted_counts
        _, _, _, of_token = block.pairs(shards, hot_keys)
        word_p = (counts + 1.0) / (n + v + 1.0)
        own = word_p[ids]
        context_count = np.empty(len(ids))
        context_count[1:] = counts[ids[:-1]]
        context_count[ptr[:-1]] = trained_docs
        p = restore(codes)[of_token] + strength / (context_count + strength) * own
        docs = _open(row["docs"], np.int64).reshape(2, -1)
        sums = [np.add.reduceat(x, ptr[:-1]) for x in ((counts[ids] > 0).astype(np.int64), np.log10(own), np.log10(p))]
        return pa.table(
            [pa.array(docs[0], mask=docs[1] > 0), pa.array(block.held), pa.array(np.diff(ptr)), *map(pa.array, sums)],
            schema=_SCORES,
        )

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
