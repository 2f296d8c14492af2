from collections import Counter

import numpy as np
import pyarrow as pa

from panelwright.llm import quality
from tests.llm.common import SMALL, awkward, empty, small_documents, words


def brute(text):
    w = words(text, lower=False)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return [
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(repeated),
    ]


def test_counts_of_every_text():
    texts = small_documents().text.tolist() + [
        None, "", "\n\n", "a\na\n a\na", "x y z x y z", "a b a b a b", "é ü <#>", "\n a \n\n a \n", "q" * 9000,
    ]
    counts, x = quality.document_counts(pa.array(texts))
    assert counts.tolist() == [brute(t) for t in texts]
    assert np.isfinite(x).all()


def test_verdicts(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.judge_quality(documents, labels).collect()
    texts = dict(documents.select("doc_id", "text").collect())
    for r in rows:
        n, _, _, _, repeat = brute(texts[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and r.score >= quality.KEEP)
    assert len(rows) == len(texts)


def test_the_model_separates_labels(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    rows = quality.judge_quality(documents, half).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(awkward(spark), labels).collect()
    assert len(rows) == 8
    assert {r.doc_id for r in rows if not r.base_failed} <= {5}
    assert quality.judge_quality(empty(spark), labels).isEmpty()
    assert quality.judge_quality(awkward(spark), empty(spark, "doc_id long, quality int, toxic int")).count() == 8
