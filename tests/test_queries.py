"""Every query of the library with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from scholia import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if v != v else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    got = df.collect()
    want = duck.execute(plans.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).limit(5).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
