"""Every registered query with a SQL twin gives the same rows as DuckDB on the same tables."""

import decimal
import os

import duckdb
import pytest

from echoloom import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = df.collect()
    sql = catalog.oracles().get(name)
    if sql is None:
        assert got
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, rel.fetchall())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["class", "threshold", "triggers", "hours", "fa_per_hour"] and df.count() == 5


def test_names_are_free_of_reserved_patterns():
    assert not any("pipeline" in n or n.startswith("op") for n in catalog.queries())
    assert len(catalog.oracles()) >= 190 and os.path.exists("bench.py")
