"""Every query that has SQL, against that SQL, on whole tables; the others must run."""

import pytest
from conftest import SMALL

from oracle import compare
from tessera.plans import registry

MAY_BE_EMPTY = {"bm25_trigram_rank", "hybrid_overfetch", "literals_only_rank", "orphan_files"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    n = compare(spark, SMALL, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert n > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert len(registry.QUERIES[name](spark, SMALL).collect()) > 0  # count() would let Spark leave the columns out
