import hashlib
import math
from collections import Counter

import pytest
import xxhash

from panelwright.llm.mixing import mix_sources, mixed_documents
from tests.llm.common import AWKWARD, DOCUMENTS, awkward, empty, small_documents, words


def brute(rows, weights=(5, 2, 1), epochs=3, seed=0):
    """(doc_id, size, source_size, target, repeats) by sorting every source."""
    sources = sorted({r[1] for r in rows if r[1] is not None}, key=lambda s: s.encode())
    sources += [None] * any(r[1] is None for r in rows)
    total = {s: sum(len(words(t)) for _, x, t in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    budget, target, open_ = float(sum(total.values())), {}, list(sources)
    while True:  # share the rest by weight until no source is above its limit
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > epochs * total[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = float(epochs * total[s])
            open_.remove(s)
    out, ids, copies = [], Counter(r[0] for r in rows), Counter()
    for s in sources:
        draws = []
        for doc_id, x, text in rows:
            if x != s:
                continue
            size, body = len(words(text)), text or ""
            quality = max(0.05, 1 - sum(c in "#*$%&|<>" for c in body) / max(size, 1))
            name = f"{seed}:{'null' if doc_id is None else doc_id}"
            text_key = xxhash.xxh64(body.encode(), seed=42).intdigest()
            text_key -= 2**64 * (text_key >= 2**63)
            copy = -1
            if ids[doc_id] > 1:
                copy = copies[doc_id, x, body]
                copies[doc_id, x, body] += 1
                name += f":{text_key}:{copy}"
            u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            draws.append((-math.log(u) / quality, -(2**63) if doc_id is None else doc_id, size, text_key, copy))
        draws.sort()
        full = int(target[s] // total[s]) if total[s] else 0
        rest, before, chosen = target[s] - full * total[s], 0, set()
        for draw in draws:
            if before + draw[2] / 2 < rest:
                chosen.add(draw)
            before += draw[2]
        out += [
            (None if d[1] == -(2**63) else d[1], d[2], total[s], target[s], full + (d in chosen)) for d in draws
        ]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("bucket_rows", [3, 5_000])
def test_every_source_meets_its_target(spark, bucket_rows):
    table = small_documents()
    rows = [(i, s if i % 9 else None, t) for i, s, t in zip(table.doc_id, table.source, table.text, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_sources(frame, bucket_rows=bucket_rows).collect()
    expected = sorted(brute(rows), key=key)
    mine = sorted(((r.doc_id, r.size, r.source_size, r.target, r.repeats) for r in got), key=key)
    assert [(a, b, c, e) for a, b, c, _, e in mine] == [(a, b, c, e) for a, b, c, _, e in expected]
    assert [r[3] for r in mine] == pytest.approx([r[3] for r in expected])
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
        assert all(r.taken == r.size * r.repeats and r.repeats <= 3 for r in own)
    assert sorted(mix_sources(frame, bucket_rows=bucket_rows).collect()) == sorted(got)


@pytest.mark.parametrize(("a", "b"), [(7, 8), (None, None), (7, 7)])
@pytest.mark.parametrize("same_text", [False, True])
def test_rows_that_share_an_id_meet_the_target(spark, a, b, same_text):
    rows = [(i, s, "ten words " * 5 + ("" if same_text else f"{k}")) for i, s in ((a, "a"), (b, "b")) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mix_sources(frame, bucket_rows=20).collect()
    mine = sorted(((r.doc_id, r.size, r.source_size, r.repeats) for r in got), key=key)
    assert mine == sorted(((i, n, t, k) for i, n, t, _, k in brute(rows)), key=key)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
    mixed = mixed_documents(frame, bucket_rows=20).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in mixed} == {s: sum(r.repeats for r in got if r.source == s) for s in "ab"}


def test_the_mix_repeats_documents(spark):
    table = small_documents()
    frame = spark.createDataFrame(table)
    plan = {r.doc_id: r.repeats for r in mix_sources(frame).collect()}
    mixed = mixed_documents(frame)
    assert mixed.columns == frame.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v}


def test_awkward_rows(spark):
    rows = mix_sources(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    expected = brute([(i, s, t) for i, t, _, s, _ in AWKWARD])
    assert sorted(((r.doc_id, r.size, r.repeats) for r in rows), key=key) == sorted(
        ((a, b, e) for a, b, _, _, e in expected), key=key
    )
    assert mixed_documents(awkward(spark)).columns == awkward(spark).columns
    assert mix_sources(empty(spark)).isEmpty() and mixed_documents(empty(spark)).isEmpty()
    silent = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "b", 0)], DOCUMENTS)
    assert {(r.target, r.taken) for r in mix_sources(silent).collect()} == {(0.0, 0)}
