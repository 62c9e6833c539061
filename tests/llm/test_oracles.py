"""The operators' queries that have SQL, held against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from sitelumen.llm import queries
from tests.test_oracles import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


def test_the_entry_has_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
