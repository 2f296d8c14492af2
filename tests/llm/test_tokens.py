import random

import numpy as np
import pyarrow as pa

from panelwright.llm import tokens
from tests.llm.common import AWKWARD, words


def test_words_match_the_pattern_in_every_text():
    texts = [t for _, t, *_ in AWKWARD] + ["A b", "x", None]
    found = tokens.words_of(pa.array(texts, pa.string()))
    data = found.raw.tobytes()
    for d, text in enumerate(texts):
        own = range(found.ptr[d], found.ptr[d + 1])
        assert [data[found.start[k] : found.end[k]].decode() for k in own] == words(text)


def test_hashes_depend_on_the_bytes_alone():
    rng = random.Random(1)
    vocabulary = ["a", "a\0", "ab", "ba", "b", "\0", "é", "abc" * 40]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(50)]
    found = tokens.words_of(pa.array(texts))
    h = tokens.word_hash(found)
    seen = {}
    for value, word in zip(h.tolist(), [w for t in texts for w in words(t)], strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(vocabulary)


def test_shingles_are_the_distinct_windows():
    texts = ["a b c a b c a", "a b", "", None, "a b c", "x y z w"]
    values, ptr = tokens.shingles(tokens.words_of(pa.array(texts, pa.string())), 3)
    sizes = []
    for text in texts:
        w = words(text)
        sizes.append(len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) or int(bool(w)))
    assert np.diff(ptr).tolist() == sizes
    assert set(values[ptr[4] : ptr[5]]) <= set(values[ptr[0] : ptr[1]])


def test_chunks_hold_every_row_once_whatever_their_size():
    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "text": ["x" * n for n in (0, 5, 900, 1, 1, 2000, 3, 0, 7)]})
    for size in (1, 100, 1000, 10**6):
        parts = list(tokens.chunks(batch, size=size))
        assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(9))
    assert list(tokens.chunks(batch.slice(0, 0))) == []
