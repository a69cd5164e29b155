"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from geostrata import queries as core
from geostrata.queries.base import TABLES
from tests.conftest import DATA


def plain(frame):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v) + 0.0:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(geo, duck, name):
    got, want = core.queries()[name](geo, DATA).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
