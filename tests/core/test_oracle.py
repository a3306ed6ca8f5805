"""Every query that has SQL, beside DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from perilmesh.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        out.append(tuple("null" if v is None or v != v else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, db, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_others_run(spark, sf):
    for name in set(registry.queries()) - set(SQL):
        assert registry.queries()[name](spark, sf).count() > 0, name
