import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import toxicity as tox
from panelwright.llm.trees import fit_boosted, fit_isotonic
from tests.llm.common import awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def test_monotone_features_never_lower_the_score():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] + 0.5 * np.sin(4 * x[:, 1]) + rng.normal(size=1500) > 0).astype(float)
    forest = fit_boosted(x, y, monotone={0: 1, 2: -1})
    grid = np.linspace(-3, 3, 60)
    for row in x[:40]:
        for feature, sign in ((0, 1), (2, -1)):
            probe = np.repeat(row[None], 60, 0)
            probe[:, feature] = grid
            assert (sign * np.diff(forest.raw(probe)) >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == (y > 0)).mean() > 0.75
    steps = np.array([[tree_walk(forest, k, row) for k in range(len(forest.value))] for row in x[:20]])
    assert np.allclose(steps.sum(1) + forest.base, forest.raw(x[:20]))


def tree_walk(forest, tree, row):
    at, inner = 0, forest.feature.shape[1]
    while at < inner:
        at = 2 * at + (2 if row[forest.feature[tree, at]] > forest.threshold[tree, at] else 1)
    return forest.value[tree, at - inner]


def test_isotonic_is_the_least_squares_step_curve():
    rng = np.random.default_rng(2)
    s = rng.uniform(size=300).round(2)
    y = (rng.uniform(size=300) < s).astype(float)
    curve = fit_isotonic(s, y)
    values = curve(np.sort(s))
    assert (np.diff(values) >= -1e-12).all()
    assert values.sum() == pytest.approx(y.sum())
    assert fit_isotonic(np.empty(0), np.empty(0))(np.array([0.3]))[0] == pytest.approx(0.3)
    assert len(fit_boosted(np.zeros((0, 2)), np.zeros(0)).value) == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = tox.toxicity(documents, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    good = [r.score for r in rows if r.toxic == 0]
    bad = [r.score for r in rows if r.toxic == 1]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.75
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_features_count_what_they_name():
    lexicon = tox.Lexicon(tox._hash_list("foo"), np.array([3.0]))
    column = pa.array(["You are an IDIOT and a foo", "an idiot " + "word " * 20 + "you", "1d1ot st*pid", None, ""])
    x = dict(zip(tox.FEATURES, tox.features(column, lexicon).T, strict=True))
    assert x["insults"].tolist() == [1, 1, 0, 0, 0]
    assert x["learned"].tolist() == [1, 0, 0, 0, 0] and x["learned_weight"][0] == 3
    assert x["near_you"].tolist() == [2, 0, 0, 0, 0]
    assert x["disguised_insults"].tolist() == [0, 0, 1, 0, 0]
    assert x["capitals"][0] == pytest.approx(6 / 20)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 7)] + [(None, 1, 1), (4, 1, 1), (2, 0, None)], LABELS)
    rows = tox.toxicity(awkward(spark), labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    none = empty(spark, LABELS)
    assert {round(r.score, 6) for r in tox.toxicity(awkward(spark), none).collect()} == {0.5}
    assert tox.toxicity(empty(spark), labels).isEmpty()
    kept = tox.drop_toxic(awkward(spark), none)
    assert kept.columns == awkward(spark).columns and kept.count() == 8
    plain = awkward(spark).withColumn("at", F.lit("2020-01-01").cast("timestamp"))
    assert tox.drop_toxic(plain, labels).dtypes == plain.dtypes


def test_the_sample_has_one_row_for_an_id(spark):
    rows = [(7, f"text {k}") for k in range(500)] + [(8, None), (9, "other")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, toxic int")
    for bound in (1, 2, 10):
        sample = tox.labelled_sample(documents, labels, "toxic", bound, F.lit(True)).collect()
        assert len(sample) == len({r.doc_id for r in sample}) == min(bound, 3)
    assert tox.labelled_sample(documents.repartition(7), labels, "toxic", 10, F.lit(True)).exceptAll(
        tox.labelled_sample(documents, labels, "toxic", 10, F.lit(True))
    ).isEmpty()
