"""Every llm query on the smallest tables equals its SQL or what is computed again."""

import pytest

from compare import compare
from sparkmoment.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, SF, name)
    assert ok, said


def test_sql_names_are_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
