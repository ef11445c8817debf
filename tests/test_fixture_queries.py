"""Every fixture query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from orebase.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].map(lambda v: v.tolist() if hasattr(v, "tolist") else v).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())
