import re

import pytest

from panelwright.llm.oracle import SQL
from panelwright.llm.queries import QUERIES
from tests.llm.common import SMALL
from workload.check import connect, differences


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) is None
