"""Every query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    assert name in SQL
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    want = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert plain(got) == plain(want)
