"""Every operator query that has SQL, against that SQL, on whole tables."""

import pytest
from conftest import SF

from oracle import compare
from tessera.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0
