"""Every catalogue query with an SQL oracle must agree with DuckDB on the
sf0.001 tables (row count, column names, values)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL
from civicflow.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = catalog.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = catalog.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(srows) == len(drows)
    assert _rows(sdf.columns, srows) == _rows(rel.columns, drows)


def test_every_query_builds(spark):
    qs = catalog.queries()
    for name in ("fair_compare", "fair_adjusted_rates"):
        assert qs[name](spark, SF_SMALL).count() >= 0
