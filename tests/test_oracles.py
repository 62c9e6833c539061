"""Every registered query that has SQL, held against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from sitelumen import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, Decimal)) and not isinstance(value, bool):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    return str(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, folder: str = FOLDER) -> int:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names, want = [x[0] for x in found.description], found.fetchall()
    got = query(spark, folder)
    assert sorted(got.columns) == sorted(names)
    got = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert got == rows_of(names, want)
    return len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name]) >= 0


def test_variants_of_all_rules_equal_sql(spark, tmp_path):
    """All six steps of every rule, which takes more pages than the smallest table has."""
    from sitelumen import variants

    spark.range(variants.STEPS * len(variants.VARIANTS)).toDF("page_id").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(variants.oracle()).fetchall()
    got = queries.QUERIES["rule_variants"](spark, str(tmp_path)).collect()
    assert rows_of(["a", "b", "c"], [tuple(r) for r in got]) == rows_of(["a", "b", "c"], want) and {r["rule_id"] for r in got} == set(variants.VARIANTS)


def test_duplicate_titles_have_every_page(spark, tmp_path):
    """Also those beyond the number of pages that a finding shows."""
    page = "'<html><head><title>One title</title></head><body><p>x</p></body></html>'"
    spark.range(1, 1201).selectExpr("id AS page_id", "concat('https://a.test/', id) AS url", f"{page} AS html").coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["duplicate_titles"])
    names, want = [x[0] for x in found.description], found.fetchall()
    got = queries.QUERIES["duplicate_titles"](spark, str(tmp_path))
    got = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert got == rows_of(names, want) and got[0][1] == "1200"
