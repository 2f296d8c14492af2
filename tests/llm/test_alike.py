import random

import pytest
from pyspark.sql import functions as F

from panelwright.llm.alike import meetings_of_alike
from panelwright.llm.near_dup import near_duplicates
from tests.llm.test_near_dup import brute, check


def drifting(n, seed):
    """Every text is the one before with a few words replaced, so links form long chains."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = {}
    for i in range(n):
        texts[i] = " ".join(words)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(90)] = f"new{rng.randrange(10**6)}"
    return texts


def near_copies(n, seed, most=5):
    """Copies of one page that differ in up to so many words of 120."""
    rng = random.Random(seed)
    base = [f"page{k}" for k in range(120)]
    texts = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, most + 1)):
            copy[rng.randrange(120)] = f"edit{rng.randrange(10**9)}"
        texts[i] = " ".join(copy)
    return texts


def one_template(n, own=30):
    """Pages of 120 words that share all but so many, and have no link."""
    return {i: " ".join([f"template{k}" for k in range(120 - own)] + [f"own{i}_{k}" for k in range(own)]) for i in range(n)}


def meetings(spark, texts, limit, width=3, numerator=85):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes, links = meetings_of_alike(
        frame.select("doc_id"), frame, width=width, numerator=numerator, denominator=100, limit=limit
    )
    links = [] if links is None else [(r.a, r.b) for r in links.collect()]
    members = {}
    for r in nodes.collect():
        members.setdefault(r.node, set()).add(r.doc_id)
    return list(members.values()), links


def linked_pairs(texts, width=3, numerator=85):
    sets = {}
    for i, text in texts.items():
        w = text.split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(sets)
    return [
        (i, j)
        for n, i in enumerate(ids)
        for j in ids[:n]
        if 100 * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j])
    ]


@pytest.mark.parametrize("make", [lambda: drifting(150, 1), lambda: near_copies(120, 2), lambda: one_template(120)])
def test_every_link_meets_in_a_node_or_is_connected_by_pivots(spark, make):
    texts = make()
    pairs = linked_pairs(texts)
    members, links = meetings(spark, texts, 12)
    assert set(links) <= set(pairs)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    for a, b in pairs:
        assert find(a) == find(b) or any(a in m and b in m for m in members)


@pytest.mark.parametrize("make", [lambda n: near_copies(n, 5, 2), one_template, lambda n: one_template(n, 14)])
def test_comparisons_of_alike_documents_grow_with_their_number(spark, make):
    work = []
    for n in (600, 2400):
        members, links = meetings(spark, make(n), 60)
        work.append((sum(map(len, members)) + len(links), sum(len(m) ** 2 for m in members)))
    (few_rows, few_pairs), (many_rows, many_pairs) = work
    assert many_rows <= 5 * few_rows + 2400
    assert many_pairs <= 6 * few_pairs + 2400 * 60


def test_classes_of_alike_documents_equal_brute_force(spark):
    texts = {}
    for part in (drifting(80, 3), near_copies(60, 4), one_template(60)):
        texts |= {len(texts) + i: t for i, t in part.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(frame, texts, 3, 85, 100, node_limit=10)
    check(frame, texts, 5, 80, 100, node_limit=10)


def test_rows_that_share_an_id_and_texts_without_words(spark):
    texts = near_copies(60, 6)
    rows = [*texts.items(), (3, ""), (3, None), (7, "  \t"), (None, "page1 page2 page3"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shell", F.lit("x")).withColumn("pivot", F.lit(1))
    got = near_duplicates(frame, shingle_words=3, numerator=85, node_limit=6).collect()
    assert len(got) == len(rows)
    component, _ = brute(texts, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.n_shingles > 0} == component
