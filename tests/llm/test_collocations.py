import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.llm import collocations as operator
from panelwright.llm.collocations import collocations
from tests.llm.common import AWKWARD, awkward, empty, small_documents

PLAIN = "text string, lang string"


def brute(rows, limit=2000, least=10, swallowed=50):
    """All phrases of all texts, counted and scored."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = [(p, a) for p, a in candidates.items() if len(p) == 3]
        gone = {q for p, a in longer for q in (p[:2], p[1:]) if 100 * a >= swallowed * f[q]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, k + 1, p, a, left, r, n, score) for k, (score, a, p, left, r) in enumerate(rows[:limit])]
    return sorted(out)


def result(frame, **settings):
    rows = collocations(frame, **settings)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("limit", [2000, 40])
def test_small_documents(spark, limit):
    table = small_documents()
    want = brute(table[["text", "lang"]].itertuples(index=False, name=None), limit)
    assert result(spark.createDataFrame(table).repartition(3), limit=limit) == want
    assert len(want) > 40


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["É", "don't", "x\x1fy", "-"]
    fixed = [("red", "hot", "iron"), ("new", "york"), ("in", "new", "york"), ("of", "the")]
    rows = []
    for _ in range(600):
        text = []
        for _ in range(rng.randrange(30)):
            text += rng.choice(fixed) if rng.random() < 0.15 else [rng.choices(words, [1 / (k + 2) for k in range(64)])[0]]
            text.append(rng.choice([" ", " ", "  ", "\t ", ". ", "\n", ", "]))
        rows.append(("".join(w if re.match(r"\s|[.,]", w) else w + " " for w in text).title(), rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("settings", [{}, {"limit": 5}, {"limit": 1, "swallowed": 1}, {"least": 3, "limit": 70}])
def test_random_texts(spark, texts, settings):
    assert result(spark.createDataFrame(texts, PLAIN).repartition(5), **settings) == brute(texts, **settings)


@pytest.mark.parametrize("entries", [1, 1 << 13])
def test_shared_flags_change_nothing(spark, texts, entries):
    got = result(spark.createDataFrame(texts, PLAIN), entries=entries, limit=30)
    assert got == brute(texts, 30)


def test_rounds_go_on_until_settled(spark, monkeypatch):
    """Most pairs above the first floors are swallowed, so several rounds are needed."""
    rounds = []
    grow = operator._triples
    monkeypatch.setattr(operator, "_triples", lambda *a: rounds.append(1) or grow(*a))
    monkeypatch.setattr(operator, "FIRST", 1)
    rows = []
    for k in range(40):
        rows += [(f"a{k} b{k} c{k} d{k} e{k}", "en")] * 12 + [(f"a{k} x. y e{k}", "en")] * 3
    rows += [(f"p{k} q{k}. p{k} z", "en") for k in range(30) for _ in range(20)]
    for limit in (10, 100):
        assert result(spark.createDataFrame(rows, PLAIN), limit=limit) == brute(rows, limit)
    rows = [(f"{'abc'[k % 3]} m{k} n", "de") for k in range(30) for _ in range(11 + k)]
    assert result(spark.createDataFrame(rows, PLAIN), limit=3, swallowed=1) == brute(rows, 3, swallowed=1)
    assert len(rounds) > 3


def test_growth_is_pruned(spark, monkeypatch):
    """Three words that cannot reach the floor nor swallow a pair above it are not counted."""
    counted = []
    count = operator._counts

    def noted(texts, length, flags=None):
        counts = count(texts, length, flags)
        counted.append((length, counts.count()))
        return counts

    monkeypatch.setattr(operator, "_counts", noted)
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abcdefghij", k=40)), "en") for _ in range(300)]
    rows += [("good phrase stands", "en")] * 20
    assert result(spark.createDataFrame(rows, PLAIN), limit=1) == brute(rows, 1)
    assert dict(counted)[3] < 20


def test_scores_are_exact(spark):
    for a, left, right in [(10**13 - 1, 10**13 + 7, 10**13 - 1), (3 * 10**12 + 1, 9 * 10**13, 3 * 10**12 + 2), (11, 13, 17)]:
        got = spark.range(1).select(operator._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first().s
        assert got == 10**6 * a * a // (left * right)


def test_awkward_rows(spark):
    want = brute([(r[1], r[2]) for r in AWKWARD], least=1)
    assert result(awkward(spark), least=1) == want and len(want) > 2000
    assert collocations(empty(spark)).isEmpty()
