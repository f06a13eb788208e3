"""Every core query runs on the smallest tables; those with SQL equal it."""

import pytest

from compare import compare
from sparkmoment import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, SF, name)
    assert ok, said


def test_sql_names_are_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
