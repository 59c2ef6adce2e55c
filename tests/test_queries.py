"""Every registered query outside of llm over the smallest tables, against its SQL where it has one."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from commitlake.plans import history, problems

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**problems.QUERIES, **history.QUERIES}
ORACLES = {**problems.ORACLES, **history.ORACLES}


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(plain(tuple(r)) for r in df.select(*columns).collect())
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert rows == Counter(plain(tuple(r[i] for i in places)) for r in found.fetchall())
    else:
        assert rows


def test_no_oracle_without_a_query():
    assert set(ORACLES) <= set(QUERIES)
