"""Every query of the export against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from leafmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    return "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    names = want.columns
    b = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in duck.execute(ORACLES[name]).fetchall())
    assert a == b
