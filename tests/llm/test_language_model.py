import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm.elias_fano import EliasFano, NgramTrie, quantise, restore
from panelwright.llm.language_model import score_documents
from tests.llm.common import AWKWARD, awkward, empty, small_documents, words


def brute(rows, strength=50.0):
    def tokens(text):
        return [*words(text), "</s>"]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    word, pair, context = Counter(), Counter(), Counter()
    for i, text in rows:
        if held[i]:
            continue
        before = "<s>"
        for w in tokens(text):
            word[w] += 1
            pair[before, w] += 1
            context[before] += 1
            before = w
    n, v = sum(word.values()), len(word)
    out = []
    for i, text in rows:
        base = score = known = 0
        before = "<s>"
        for w in tokens(text):
            p = (word[w] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((pair[before, w] + strength * p) / (context[before] + strength))
            known += word[w] > 0
            before = w
        out.append((i, held[i], len(tokens(text)), known, n, base, score))
    return out


def agree(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[6] == pytest.approx(b[6], abs=2e-4 * b[2] + 1e-6)


@pytest.mark.parametrize(("block", "shard"), [(1_000_000, 2_500_000), (4_000, 9_000)])
def test_scores_follow_the_formula(spark, block, shard):
    table = small_documents()
    frame = spark.createDataFrame(table[["doc_id", "text"]]).repartition(3)
    got = score_documents(frame, block_tokens=block, shard_tokens=shard).collect()
    expected = brute(list(zip(table.doc_id.tolist(), table.text, strict=True)))
    agree(got, expected)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_a_hot_context_is_dealt_over_shards(spark):
    rows = [(k, " ".join(f"the x{(k * 31 + j) % 97}" for j in range(60))) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    agree(score_documents(frame, block_tokens=500, shard_tokens=1000).collect(), brute(rows))


def test_awkward_rows(spark):
    agree(score_documents(awkward(spark)).collect(), brute([(i, t) for i, t, *_ in AWKWARD]))
    assert score_documents(empty(spark)).isEmpty()


@pytest.mark.parametrize(("size", "bits"), [(0, 64), (1, 64), (2, 3), (1000, 64), (5000, 20), (300, 9)])
def test_elias_fano_gives_back_its_values(size, bits):
    rng = np.random.default_rng(size)
    limit = 2**bits - 1
    values = np.unique(rng.integers(0, limit, size * 2, dtype=np.uint64, endpoint=True))[:size]
    coded = EliasFano(values, bits)
    assert (coded.get(np.arange(len(values))) == values).all()
    assert (coded.find(values) == np.arange(len(values))).all()
    others = np.setdiff1d(rng.integers(0, limit, 500, dtype=np.uint64, endpoint=True), values)
    assert (coded.find(others) == -1).all()


def test_the_trie_finds_successors_of_a_context_only():
    rng = np.random.default_rng(8)
    pairs = np.unique(np.stack([rng.integers(0, 50, 2000), rng.integers(0, 300, 2000)], 1), axis=0)
    context, successor = pairs[:, 0].astype(np.uint64) << np.uint64(50), pairs[:, 1].astype(np.uint32)
    p = rng.uniform(1e-8, 1, len(pairs))
    trie = NgramTrie(context, successor, p)
    ask_context = np.arange(60, dtype=np.uint64) << np.uint64(50)
    ask = np.tile(np.arange(300, dtype=np.uint32), 60)
    codes = trie.look_up(ask_context, np.full(60, 300), ask).reshape(60, 300)
    expected = np.zeros((60, 300), np.uint16)
    expected[pairs[:, 0], pairs[:, 1]] = quantise(p)
    assert (codes == expected).all()
    assert np.allclose(np.log10(restore(quantise(p))), np.log10(p), atol=1e-4)
