import random

from panelwright.llm.components import connected_components
from panelwright.llm.near_dup import agreement_for, drop_near_duplicates, near_duplicates, trees_for
from tests.llm.common import DOCUMENTS, awkward, empty, small_documents, words


def brute(texts, width, numerator, denominator):
    """Component of every id by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in texts if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * denominator < max(len(a), len(b)) * numerator:
                continue
            common = len(a & b)
            if denominator * common >= numerator * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def check(frame, texts, width, numerator, denominator, **settings):
    rows = near_duplicates(
        frame, shingle_words=width, numerator=numerator, denominator=denominator, **settings
    ).collect()
    component, sizes = brute(texts, width, numerator, denominator)
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.component_id, row.n_shingles) == (component[row.doc_id], sizes[row.doc_id])
        assert row.kept == (row.doc_id == row.component_id)


def test_all_pairs_of_the_small_table(spark):
    table = small_documents()
    texts = dict(zip(table.doc_id.tolist(), table.text, strict=True))
    check(spark.createDataFrame(table[["doc_id", "text"]]), texts, 3, 85, 100)


def edited_copies():
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts, line = {}, " ".join(f"common{k}" for k in range(12))
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    for i in range(60, 120):  # alike in one line only
        texts[i] = line + " " + " ".join(f"own{i}_{k}" for k in range(rng.randrange(4, 20)))
    return texts


def test_large_nodes_branch_and_are_compared_in_blocks(spark):
    texts = edited_copies()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(frame, texts, 3, 85, 100, node_limit=8)
    check(frame, texts, 5, 80, 100)


def pairs_inside_one_template(n):
    """Pairs at a similarity of exactly 0.8 on single words; two pairs have 0.64."""
    texts, template = {}, [f"template{k}" for k in range(70)]
    for i in range(2 * n):
        own = [f"pair{i // 2}_{k}" for k in range(10)] + [f"own{i}_{k}" for k in range(10)]
        texts[i] = " ".join(template + own)
    return texts


def test_trees_miss_pairs_of_a_large_node_independently(spark):
    texts = pairs_inside_one_template(300)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_duplicates(frame, shingle_words=1, numerator=80, denominator=100, node_limit=100).collect()
    assert len(rows) == len(texts)
    assert [r.doc_id for r in rows if r.component_id != r.doc_id // 2 * 2] == []


def test_awkward_rows(spark):
    rows = near_duplicates(awkward(spark), shingle_words=3, numerator=85).collect()
    assert len(rows) == 8
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0]
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 6)] == [1, 2, 3, 4, 5, 6]
    assert by_id[None].component_id is None and by_id[None].kept
    kept = drop_near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert near_duplicates(empty(spark)).isEmpty() and drop_near_duplicates(empty(spark)).isEmpty()


def test_rows_of_one_id_are_dropped_only_for_their_text(spark):
    rows = [(8, "a b c d e f g"), (8, "quite another text of the same id"), (8, "A b c d e f g"), (3, "a b c d e f g"), (5, None), (5, None)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(3, rows[3][1]), (5, ""), (8, rows[1][1])]


def test_copies_in_any_case_form_one_class(spark):
    rows = [(9, "A B c d", None, None, 0), (3, "a b C D", None, None, 0), (7, "a  b\nc d", None, None, 0), (5, "a", None, None, 0), (6, "A", None, None, 0)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert got == {9: 3, 3: 3, 7: 3, 5: 5, 6: 5}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k + 1, k) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (50, 51), (51, 50)]
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(frame).collect()}
    expected = {k: 10 for k in range(11, 41)} | {k: 100 for k in range(101, 130)} | {51: 50}
    assert got == expected


def test_recall_settings():
    assert 0.15 ** trees_for(85, 100, 1e-6) <= 1e-6
    assert 32 < agreement_for(85, 100, 64, 1e-6) < 0.85 * 64
