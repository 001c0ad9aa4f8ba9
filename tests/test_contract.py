"""The driver's contract: names agree, and the catalogue's queries give the rows of their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratakv.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)
