from panelwright.llm.secrets import candidates, evidence, find_secrets, variants, with_features
from tests.llm.common import SMALL, awkward, empty

import re


def test_candidates_and_their_order(spark):
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b, order: 1234567890123456 end abcdefghijklmnopqrst id9'
    frame = spark.createDataFrame([(1, text), (2, text.upper())], "doc_id long, text string")
    rows = sorted(find_secrets(frame).collect())
    assert [(r.doc_id, r.nth, len(r.candidate)) for r in rows] == [(1, 0, 40), (1, 1, 16), (2, 0, 40), (2, 1, 16)]
    assert [r.secret for r in rows] == [True, False, True, False]


def test_planted_tokens_of_a_table(spark):
    documents = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    texts = documents.select("doc_id", "text").collect()
    planted = {(r.doc_id, t) for r in texts for t in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    rows = find_secrets(documents).collect()
    assert planted and {(r.doc_id, r.candidate) for r in rows if r.secret} == planted
    long_runs = {
        (r.doc_id, run)
        for r in texts
        for run in re.findall(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}", r.text)
        if re.search("[0-9]", run)
    }
    assert {(r.doc_id, r.candidate) for r in rows} == long_runs


def test_labelled_findings_decide(spark):
    schema = "candidate string, before string, after string, label double"
    rows = [(f"{k:016d}", "order: ", " end", 1.0) for k in range(60)] + [(f"deadbeef{k:032x}", 'token = "', '"', 0.0) for k in range(60)]
    frame = spark.createDataFrame([(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" order: 1234567890123456')], "doc_id long, text string")
    got = sorted(find_secrets(frame, spark.createDataFrame(rows, schema)).collect())
    assert [r.secret for r in got] == [False, True]
    none = spark.createDataFrame([], schema)
    assert {r.score for r in find_secrets(frame, none).collect()} == {0.0}


def test_awkward_rows(spark):
    assert find_secrets(awkward(spark)).isEmpty()
    assert find_secrets(empty(spark)).isEmpty()
    rows = [(None, "x 0123456789abcdef0123"), (4, "0123456789abcdef0123"), (4, "0123456789abcdef0123"), (5, "y" * 200_000 + " z9z9z9z9z9z9z9z9z9")]
    got = find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 4, 4, 5]


def test_secrets_of_other_forms(spark):
    """Unquoted, letter-only and short secrets, and what only looks like them: precision and recall."""
    keys = ["sk9QxT4mLw8ZrB2vNc7HpD5yKf3GjS6a", "q7ZpL2xVw9Rk4TmB8cNf", "Zk8vQ1nXr5Jt0LbWc3Hd", "b6TyP9mKx2Rw7VqLn4Gz"]
    secrets = (
        [f"API_KEY={k}" for k in keys]
        + [f"Authorization: Bearer {k}" for k in keys]
        + [f'password = "{k}"' for k in ("Sh0rt!pw", "x9$Kq2vB", "T7#mWz4p!")]
        + [f'client_secret: "{k}"' for k in ("qWzXkVbTnRpLmGhJdFsCyKxQvZtBwNrPgM", "hXvQzKwRtJpLbNmGfDsCyTxWkVqZrBnPjH")]
        + [f"db2_primary_password_01 = {k}" for k in keys]
    )
    harmless = [
        "password: changeme",
        'api_key = "your_token_here"',
        "The token: international agreements",
        "author: Bartholomew Williamson",
        "a secret: everybody knows",
        "commit 3f2a9c1e7b5d4f6a8c0e2d4b6f8a1c3e5d7f9b0a was built",
        "order: 9807915762804490",
        "card 4929123412341234",
        "the bearer of extraordinarily good news",
        "password = xxxxxxxxxxxxxxxx",
        "see chapter-2-of-the-long-book",
    ]
    frame = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    planted = [(10_000_000 + k, f"Some words stand here. {x} and more follow.") for k, x in enumerate(secrets + harmless)]
    # Learned from the table alone; what is planted is not among the findings.
    findings = variants(evidence(with_features(candidates(frame))))
    rows = find_secrets(spark.createDataFrame(planted, frame.schema), findings).collect()
    want = {10_000_000 + k for k in range(len(secrets))}
    got = {r.doc_id for r in rows if r.secret}
    assert {r.doc_id for r in rows} >= want
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got), (want - got, got - want)


def test_a_candidate_that_names_the_next(spark):
    text = "x db2_primary_password_01 = q7ZpL2xVw9Rk4TmB8cNf, then 0123456789abcdef01 end"
    got = candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("nth").collect()
    assert [r.candidate for r in got][-2:] == ["q7ZpL2xVw9Rk4TmB8cNf", "0123456789abcdef01"]
    for r in got:
        at = text.index(r.candidate)
        assert r.before == text[max(0, at - 120) : at] and r.after == text[at + len(r.candidate) :][:60]
