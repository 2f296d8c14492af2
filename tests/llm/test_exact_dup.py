import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwright.llm.exact_dup import exact_duplicates
from tests.llm.common import AWKWARD, awkward, empty, small_documents

PLAIN = "doc_id long, text string"


def brute(rows, keep=max):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep_id = keep(named) if named else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = Counter({keep_id: 1})
        for i in sorted(ids, key=str):
            out.append((i, keep_id, len(ids), bool(stays[i]), sha))
            stays[i] = 0
    return sorted(out, key=str)


def result(frame, **settings):
    rows = exact_duplicates(frame, **settings)
    assert rows.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize(("keep", "pick"), [("smallest", min), ("largest", max)])
def test_small_documents(spark, keep, pick):
    table = small_documents()
    want = brute(zip(table.doc_id.tolist(), table.text, strict=True), pick)
    assert result(spark.createDataFrame(table), keep=keep) == want
    assert any(not kept for *_, kept, _ in want)


# hashes under which different texts meet: by their first letter, and all of them
@pytest.mark.parametrize("weak", [lambda sha, text: F.substring(text, 1, 1), lambda sha, text: F.lit(7)])
def test_texts_that_share_a_hash_stay_apart(spark, weak):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "ab", "b", "bc", "bcd", "", None])) for k in range(200)]
    rows += [(k + 200, f"only {k}") for k in range(20)]
    rows += [(5, "ab"), (5, "ab"), (None, "ab"), (None, "none has an id"), (None, "none has an id")]
    frame = spark.createDataFrame(rows, PLAIN).repartition(5)
    for keep, pick in (("smallest", min), ("largest", max)):
        assert result(frame, keep=keep, hashed=weak) == result(frame, keep=keep) == brute(rows, pick)


def test_one_group_with_most_rows(spark):
    rows = [(k, "the same" if k % 3 else f"text {k}") for k in range(3000)]
    assert result(spark.createDataFrame(rows, PLAIN).repartition(6), keep="largest") == brute(rows)


def test_extreme_ids_and_texts_that_only_look_equal(spark):
    ids = [-(2**63), 2**63 - 1, -1, 0]
    rows = [(i, "x") for i in ids] + [(7, "é"), (8, "é"), (9, "x "), (10, "X"), (11, "x\x00"), (12, "x")]
    frame = spark.createDataFrame(rows, PLAIN)
    assert result(frame, keep="largest") == brute(rows, max)
    assert result(frame, keep="smallest") == brute(rows, min)


def test_normalised_texts(spark):
    frame = spark.createDataFrame([(1, " A b"), (2, "a b "), (3, "a  b")], PLAIN)
    rows = {r[0]: r for r in result(frame, normalise=lambda t: F.lower(F.trim(t)))}
    assert rows[1][1:3] == rows[2][1:3] == (1, 2) and rows[3][2] == 1
    assert rows[1][4] == hashlib.sha256(b"a b").hexdigest()


def test_awkward_rows(spark):
    want = brute([(r[0], r[1]) for r in AWKWARD], max)
    assert result(awkward(spark), keep="largest") == want
    assert exact_duplicates(empty(spark)).isEmpty()


def test_an_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError, match="keep"):
        exact_duplicates(empty(spark), keep="any")
