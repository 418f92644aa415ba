"""Corpus queries against their DuckDB SQL, as the driver compares them."""

import pytest
from llm_fixtures import SF001
from oracle import compare

from voltsight.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import oracle
    oracle._SPARK_TO_DUCK.setdefault("int", "INTEGER")
    compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF001)
