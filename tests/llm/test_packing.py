import random

import numpy as np
import pyarrow as pa

from panelwright.llm.packing import Capacities, Encoder, best_fit, encoding, packed_rows, position_ids, read_vocabulary, write_packed
from panelwright.llm.queries import VOCABULARY
from panelwright.scratch import scratch_root
from tests.llm.common import AWKWARD, awkward, empty, small_documents

RANKS = read_vocabulary(VOCABULARY)


def unpack(rows, row_tokens):
    """(ids, positions) of every document piece."""
    pieces = []
    for r in rows:
        ids = np.frombuffer(r.token_ids, "<u2")
        assert len(ids) == row_tokens and r.cu_lengths[0] == 0 and r.cu_lengths[-1] == r.n_tokens
        assert set(ids[r.n_tokens :].tolist()) <= {50256}
        positions = position_ids(r.cu_lengths, r.start_positions)
        assert len(positions) == r.n_tokens
        for doc, a, b, start in zip(r.doc_ids, r.cu_lengths, r.cu_lengths[1:], r.start_positions, strict=False):
            assert positions[a:b] == list(range(start, start + b - a))
            pieces.append((doc, start, ids[a:b].tolist()))
    return pieces


def test_documents_come_back_from_their_rows(spark):
    table = small_documents()
    bpe = encoding(RANKS)
    rows = packed_rows(spark.createDataFrame(table), VOCABULARY, row_tokens=256).collect()
    texts = {}
    for doc, start, ids in sorted(unpack(rows, 256)):
        assert start == len(texts.setdefault(doc, []))
        texts[doc] += ids
    assert len(texts) == len(table)
    for doc, text in zip(table.doc_id, table.text, strict=True):
        assert texts[doc] == [*bpe.encode_ordinary(text), 50256]
        assert bpe.decode(texts[doc][:-1]) == text
    used = sum(r.n_tokens for r in rows)
    assert used > 0.98 * 256 * len(rows)


def test_any_white_space_gives_the_ids_of_the_whole_text():
    rng = random.Random(2)
    marks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "Bé", "'s", "12", "!?", "ß語"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(3000)]
    bpe = encoding(RANKS)
    encoder = Encoder(RANKS)
    for part in (texts[:5], texts[5:]):
        ids, ptr = encoder.encode(pa.array([*part, None]))
        for d, text in enumerate([*part, ""]):
            assert ids[ptr[d] : ptr[d + 1]].tolist() == bpe.encode_ordinary(text), repr(text)


def test_best_fit_takes_the_fullest_row_with_room():
    rng = random.Random(4)
    for most in (1, 7, 64, 100):
        lengths = np.array([rng.randrange(1, most + 1) for _ in range(200)])
        got = best_fit(lengths, most)
        rooms = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [room for room in rooms if room >= lengths[k]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[k]
            else:
                rooms.append(most - lengths[k])
        load = np.bincount(got, lengths)
        assert load.max() <= most
        assert sorted(most - load) == sorted(rooms)
    empty_tree = Capacities(9)
    assert empty_tree.take(1) is None


def test_awkward_rows(spark):
    rows = packed_rows(awkward(spark), VOCABULARY).collect()
    pieces = unpack(rows, 2048)
    assert sum(start == 0 for _, start, _ in pieces) == len(AWKWARD)
    by_id = {doc: ids for doc, start, ids in pieces if not start}
    assert by_id[1] == by_id[2] == [50256] and None in by_id
    assert packed_rows(empty(spark), VOCABULARY).isEmpty()
    path = f"{scratch_root(spark)}/packed-test"
    write_packed(awkward(spark), VOCABULARY, path)
    assert spark.read.parquet(path).count() == len(rows)
