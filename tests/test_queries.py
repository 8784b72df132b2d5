"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import pytest

from tidemill.plans import machines, more, replay, research, setups, systems, walk  # noqa: F401  register their queries
from tidemill.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.Q))
def test_query(spark, duck, name):
    df = plans.Q[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.SQL:
        return
    found = duck.execute(plans.SQL[name]).fetchall()
    names = [x[0] for x in duck.execute(plans.SQL[name]).description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found)
