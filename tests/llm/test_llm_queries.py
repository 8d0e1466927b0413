"""Every llm query: equal to its SQL twin over the whole smallest tables, and quiet on empty ones."""

import os

import pytest

import verify
from tessera.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return verify.duck(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    res = con.execute(queries.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    assert verify.rows_of(df.columns, df.collect()) == verify.rows_of(names, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in os.listdir(sf):
        spark.read.parquet(f"{sf}/{name}").limit(0).write.parquet(str(at / name))
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name in ("p6_tokens", "p6_instructions") else 0)
