"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from deltaloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def rounded(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = [tuple(rounded(r[c]) for c in columns) for r in df.collect()]
    cursor = db.execute(catalogue.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = [tuple(rounded(r[i]) for i in at) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)
