"""Queries over tables repeated with shifted keys, so that many rows share a time, and plans that must hold at that size."""

import os

import pytest

from tests.test_queries import plain
from tidemill.plans import more, systems  # noqa: F401  register their queries
from tidemill.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """(folder, DuckDB of one thread): events and orders eight times, keys shifted, times as they are."""
    import duckdb

    d, con = tmp_path_factory.mktemp("repeated"), duckdb.connect(config={"threads": 1})
    for name, keys in (("events", ("event_id", "user_id")), ("orders", ("o_orderkey", "o_custkey"))):
        moved = ", ".join(f"{k} + x * (SELECT max({k}) + 1 FROM '{SF}/{name}.parquet') AS {k}" for k in keys)
        con.execute(f"COPY (SELECT * REPLACE ({moved}) FROM '{SF}/{name}.parquet', range(8) t(x) ORDER BY x, {keys[0]}) TO '{d}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), con


def same(spark, repeated, name):
    d, con = repeated
    df, found = plans.Q[name](spark, d), con.execute(plans.SQL[name])
    names, columns = [x[0] for x in found.description], sorted(df.columns)
    at = [names.index(c) for c in columns]
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_equal_ordinals_keep_the_first(spark, repeated):
    same(spark, repeated, "dedupe_keep_last")


@pytest.mark.parametrize("name", ["contention_ledger", "contention_family", "contention_contribution", "capacity_funnel"])
def test_contention_broadcasts_no_trades(spark, repeated, name):
    plan = plans.Q[name](spark, repeated[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    same(spark, repeated, name)


@pytest.mark.parametrize("name", ["quote_first_touch", "interval_overlap"])
def test_no_pairs_of_trades_and_quotes(spark, repeated, name):
    plan = plans.Q[name](spark, repeated[0])._jdf.queryExecution().executedPlan().toString()
    assert not any("exit_ts" in line for line in plan.splitlines() if "Join" in line)
    same(spark, repeated, name)


def test_exit_models_walk_trades_together(spark, repeated):
    df = plans.Q["exit_models"](spark, repeated[0])
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    found = {(r["trade_id"], r["model"]) for r in rows}
    assert rows and len(found) == len(rows) == 4 * len({k for k, _ in found})
