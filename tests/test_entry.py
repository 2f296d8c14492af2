"""Driver contract: every query has SQL, and they agree on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from workload.check import compare, connect
from workload.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    assert compare(spark, connection, SMALL, name) is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == [
        "scenario_id",
        "date",
        "gross_return",
        "turnover",
        "cost",
        "net_return",
        "nav",
    ]
    assert not frame.isEmpty()


@pytest.mark.parametrize("gone", [["panelwright/llm"], ["panelwright/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    """A copy without the text operators, the pipeline or both still imports and has all panel queries."""
    root = Path(contract.__file__).parent
    for name in ("panelwright", "workload"):
        skip = {Path(path).name for path in gone if Path(path).parent.name == name}
        shutil.copytree(root / name, tmp_path / name, ignore=lambda _, names, s=skip: (s | {"__pycache__"}) & set(names))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(gone):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    script = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert set(QUERIES) <= set(names) and "pipeline" not in names
    has_text = (root / "panelwright/llm").exists() and "panelwright/llm" not in gone
    assert any(name.startswith("op") for name in names) == has_text
