import random
import re
import string

from panelwright.llm.decontamination import contaminated_passages, decontaminate
from tests.llm.common import SMALL, awkward, empty

ITEM = "item_id long, text string"
GAP = re.compile("[" + re.escape(string.punctuation) + r"\x20\x09-\x0D]+")


def parts(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in GAP.split(lower) if w]


def brute(documents, items):
    """(doc, item) pairs that agree on enough words along some diagonal."""
    found = set()
    for doc, text in documents:
        d = parts(text)
        for item, passage in items:
            i = parts(passage)
            need = min(13, -(-3 * len(i) // 4))
            for diagonal in range(-len(i) + 1, len(d)):
                low, high = max(0, -diagonal), min(len(i), len(d) - diagonal)
                best = score = same = agree = 0
                for k in range(low, high):
                    equal = d[k + diagonal] == i[k]
                    score, agree = score + (1 if equal else -2), agree + equal
                    if score <= 0:
                        score = agree = 0
                    if score > best:
                        best, same = score, agree
                if i and same >= need:
                    found.add((doc, item))
    return found


def test_planted_passages_with_substitutions(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 7, 12, 15, 30, 60])))) for k in range(40)]
    items += [(100, None), (101, "")]
    documents = []
    for k in range(200):
        text = [word() for _ in range(rng.randrange(1, 120))]
        if k % 3 == 0:
            passage = (items[rng.randrange(40)][1]).split()
            for _ in range(len(passage) // 10):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice(["", ",", "%%%"]) for w in passage]
        documents.append((k, " ".join(text)))
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    got = contaminated_passages(frame, spark.createDataFrame(items, ITEM)).collect()
    expected = brute(documents, items)
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs <= expected
    # what spaced seeds miss are passages cut into pieces shorter than any seed
    assert len(expected - pairs) <= 0.02 * len(expected)


def test_recall_at_every_short_length(spark):
    rng = random.Random(5)
    items, documents = [], []
    for n in range(4, 16):
        for k in range(40):
            passage = [f"i{n}_{k}_{j}" for j in range(n)]
            items.append((100 * n + k, " ".join(passage)))
            for at in rng.sample(range(n), rng.randrange(0, 1 + n // 4)):
                passage[at] = "changed"
            around = [f"t{rng.randrange(9999)}" for _ in range(20)]
            documents.append((100 * n + k, " ".join(around[:9] + passage + around[9:])))
    long = [f"long{j}" for j in range(40)]
    items.append((1, " ".join(long)))
    for phase in range(4):
        documents.append((phase, " ".join(w if j % 4 != phase else "other" for j, w in enumerate(long))))
    got = contaminated_passages(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, ITEM))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    expected = brute(documents, items)
    assert pairs <= expected and {(phase, 1) for phase in range(4)} <= pairs
    for n in range(4, 16):
        own = {p for p in expected if p[1] // 100 == n}
        assert len(own) >= 8 and len(own & pairs) >= (1.0 if n < 10 else 0.9) * len(own), n


def test_the_small_tables(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = documents.select("doc_id", "text").collect()
    expected = brute([tuple(r) for r in rows], [tuple(r) for r in benchmark.collect()])
    got = {(r.doc_id, r.item_id) for r in contaminated_passages(documents, benchmark).collect()}
    assert got == expected and got
    kept = decontaminate(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows} - {d for d, _ in expected}


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "no id at all but some"), (2, None), (2, "two rows"), (None, "don't two blanks")], ITEM)
    got = contaminated_passages(awkward(spark), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, 1), (4, 2), (6, None)}
    assert len(got) == 4  # both rows with the same text are reported
    kept = decontaminate(awkward(spark), items)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 5]
    none = empty(spark, ITEM)
    assert contaminated_passages(awkward(spark), none).isEmpty()
    assert decontaminate(awkward(spark), none).count() == 8
    assert contaminated_passages(empty(spark), items).isEmpty()
