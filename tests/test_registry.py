import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    mine = registry.QUERIES[name](spark, sf_dir)
    theirs = oracle.execute(registry.ORACLE[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    want = sorted(repr([plain(dict(zip(names, r))[n]) for n in sorted(names)]) for r in theirs.fetchall())
    got = sorted(repr([plain(r[n]) for n in sorted(names)]) for r in mine.collect())
    assert got == want


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_plans_have_no_nested_loops_and_no_python(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("CartesianProduct", "NestedLoop", "Python", "Arrow", "Pandas") if x in plan]
