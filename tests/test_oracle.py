"""Every query with SQL, held against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import pytest

from lodestar import queries as core
from lodestar.session import TABLES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, small, duck, name):
    got = core.QUERIES[name](spark, small).toArrow()
    if name not in core.SQL:
        assert got.num_rows >= 0
        return
    want = duck.execute(core.SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)

    def rows(t):
        return sorted(tuple(plain(v) for v in r) for r in zip(*[t[c].to_pylist() for c in columns], strict=True))

    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "node_type", "name", "depth", "via"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
