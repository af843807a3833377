"""Queries of the corpus operators against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.sql(ORACLE_SQL[name]).select(*columns).fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
