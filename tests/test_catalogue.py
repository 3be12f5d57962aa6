import os

import duckdb
import pytest

from plenaria.plans import registry


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(float(r[i]), 5) if isinstance(r[i], float) else str(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for name in sorted(os.listdir(data)):
        p = f"{data}/{name}"
        c.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_flagship(spark, data):
    got = registry.flagship(spark, data)
    assert got.count() > 0 and "unbelegt" in got.columns


def test_entry_point_names():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
