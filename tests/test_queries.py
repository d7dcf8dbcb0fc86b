"""Every registered graph query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from stratagraph import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(rows):
    one = lambda v: "" if v is None or v != v else str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert normal(tuple(r[c] for c in cols) for r in df.collect()) == normal(tuple(r[i] for i in at) for r in want.fetchall())
