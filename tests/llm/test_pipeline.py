"""Each stage's effect on its own input, held against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm.mixing import mix_sources
from panelwright.llm.packing import encoding, read_vocabulary
from panelwright.llm.queries import VOCABULARY
from tests.llm.common import SMALL, awkward
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_dup import brute as groups


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def ids(frame):
    return [r.doc_id for r in frame.select("doc_id").collect()]


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(frame.columns == stages[0].columns for frame in stages[1:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect())
    kept = set(ids(stages[1]))
    gone = set(ids(stages[0])) - kept
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * sum(v == 0 for v in labels.values())
    assert len(gone) < 0.2 * len(ids(stages[0]))


def test_one_of_each_group_stays(stages):
    component, _ = groups(dict(texts(stages[1])), 5, 80, 100)
    assert sorted(ids(stages[2])) == sorted(set(component.values()))


def test_benchmark_passages_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {d for d, _ in leaks(texts(stages[2]), items)}
    assert set(ids(stages[3])) == set(ids(stages[2])) - found


def test_sources_are_mixed(stages):
    plan = {r.doc_id: r.repeats for r in mix_sources(stages[3]).collect()}
    counts = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v}


def test_rows_hold_the_mix(stages):
    bpe = encoding(read_vocabulary(VOCABULARY))
    expected = sorted(tuple([*bpe.encode_ordinary(t), 50256]) for _, t in texts(stages[4]))
    pieces = {}
    for r in stages[5].collect():
        tokens = np.frombuffer(r.token_ids, "<u2")
        for doc, a, b, start in zip(r.doc_ids, r.cu_lengths, r.cu_lengths[1:], r.start_positions, strict=False):
            pieces.setdefault((doc, start), []).append(tokens[a:b].tolist())
    assert sum(len(x) for (_, start), x in pieces.items() if start == 0) == len(expected)
    assert sum(len(p) for x in pieces.values() for p in x) == sum(map(len, expected))


def test_run_gives_the_last_stage(spark):
    frame = corpus_pipeline.run(spark, SMALL)
    assert frame.columns == ["part", "row", "n_tokens", "doc_ids", "cu_lengths", "start_positions", "token_ids"]
    assert frame.agg(F.sum("n_tokens")).first()[0] > 0


def test_awkward_rows_pass(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() > 0
