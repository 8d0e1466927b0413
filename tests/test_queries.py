"""Every core query: equal to its SQL twin over the whole smallest tables, and quiet on empty ones."""

import os

import pytest

import __spark_entry__ as entry
import verify
from tessera import plans

WRITTEN = sorted(plans.ORACLE)


@pytest.fixture(scope="module")
def con(sf):
    return verify.duck(sf)


@pytest.mark.parametrize("name", WRITTEN)
def test_query_equals_sql(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    res = con.execute(plans.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    assert verify.rows_of(df.columns, df.collect()) == verify.rows_of(names, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_other_queries_run(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in os.listdir(sf):
        spark.read.parquet(f"{sf}/{name}").limit(0).write.parquet(str(at / name))
    return str(at)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = plans.QUERIES[name](spark, empty).collect()
    dense = {"confusion_3x3": 9, "dist_profile": 17, "profile_corr": 0, "best_d": 0, "tile_profile": 17, "contour_skips": 1}
    assert len(rows) == dense.get(name, 0)
