import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from panelwright.llm import divergence
from panelwright.llm.divergence import source_divergence, term_counts
from tests.llm.common import AWKWARD, DOCUMENTS, awkward, empty, small_documents

PLAIN = "text string, lang string, source string"


def terms_of(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute(rows, least_docs=10, top=10):
    """Every share of every kept term in every source, written out."""
    texts = defaultdict(list)
    for text, lang, source in rows:
        texts[lang or "", source or ""].append(terms_of(text))
    out = []
    for lang in {a for a, _ in texts}:
        docs = Counter(t for key, own in texts.items() if key[0] == lang for words in own for t in set(words))
        kept = [t for t, n in docs.items() if n >= least_docs]
        counts = {s: Counter(t for words in own for t in words) for (a, s), own in texts.items() if a == lang}
        whole = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            own = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])]
    return sorted(out)


def result(frame, **settings):
    rows = source_divergence(frame, **settings)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows.collect())


def test_small_documents(spark):
    table = small_documents()
    want = brute(table[["text", "lang", "source"]].itertuples(index=False, name=None))
    assert result(spark.createDataFrame(table).repartition(5)) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_many_shards_blocks_and_flushes_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{'x' * (k % 7)}{chr(97 + k % 26)}é{chr(97 + k // 26 % 26)}" for k in range(300)]
    rows = []
    for _ in range(400):
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randrange(60))
        rows.append(("7, ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None])))
    frame = spark.createDataFrame(rows, PLAIN).repartition(6)
    want = brute(rows)
    assert result(frame) == want
    for name, value in (("SHARD_ROWS", 20), ("CELLS", 10), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert result(frame) == want
    assert result(frame, least_docs=60, top_terms=3) == brute(rows, 60, 3)


def test_sources_without_terms_and_languages_without_kept_terms(spark):
    rows = [("some words", "en", "a")] * 12 + [("12 34 ..", "en", "b"), (None, "en", "c"), ("rare", "fr", "a"), ("", "fr", "b")]
    got = result(spark.createDataFrame(rows, PLAIN))
    assert got == brute(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got
    assert [r[3] for r in got if r[:3] == ("en", "b", "pair")] == ["a", "c"]


def test_counts_of_documents_and_occurrences(spark):
    rows = [("A a, \x00a_b", "en", "s"), ("b-É é", "en", "s"), ("a", None, None)]
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in term_counts(spark.createDataFrame(rows, PLAIN)).collect()}
    assert got == {
        ("en", "s", "a"): (3, 1), ("en", "s", "b"): (2, 2), ("en", "s", "É"): (1, 1), ("en", "s", "é"): (1, 1),
        ("en", "s", None): (0, 0), ("", "", "a"): (1, 1), ("", "", None): (0, 0),
    }


@pytest.mark.parametrize("count", [3, 2**62])
def test_shares_are_exact(spark, count):
    shares = spark.range(1).select(
        divergence._share(divergence.F.lit(count - 1), divergence.F.lit(count), divergence.F.lit(7)).alias("p")
    )
    assert shares.first().p == 1 + 10**9 * (count + 1) // (count + 14)


def test_awkward_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in AWKWARD]
    assert result(awkward(spark), least_docs=1) == brute(rows, 1)
    assert source_divergence(empty(spark, DOCUMENTS)).isEmpty()


def test_a_task_holds_few_counts_at_a_time():
    def batches():
        for k in range(30):
            words = (f"w{chr(0xE9 + j // 676)}{chr(97 + j // 26 % 26)}{chr(97 + j % 26)}" for j in range(k * 30_000, (k + 1) * 30_000))
            yield pa.RecordBatch.from_pydict({"text": [" ".join(words)], "lang": ["en"], "source": ["a source of some length"]})

    plain = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(plain)
    pa.set_memory_pool(pool)
    try:
        counted = sum(sum(batch["n"].to_pylist()) for batch in divergence._partial_counts(batches()))
    finally:
        pa.set_memory_pool(plain)
    assert counted == 900_000 and pool.max_memory() < 30_000_000
