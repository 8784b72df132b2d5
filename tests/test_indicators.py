"""Recursive indicators against hand-computed values."""

import numpy as np
import pytest

from tidemill.operators.indicators import dmi, ema, ranges, rma, rsi

nan = float("nan")


def close(found, expected):
    assert np.allclose(found, expected, equal_nan=True)


def test_ema_seeds_with_the_first_value():
    close(ema(np.array([10.0, 12, 14, 16]), 3), [10, 11, 12.5, 14.25])


def test_rma_seeds_with_the_mean():
    close(rma(np.array([1.0, 2, 3, 5]), 3), [nan, nan, 2, 3])


def test_atr():
    high, low, last = np.array([11.0, 13, 15]), np.array([9.0, 10, 11]), np.array([10.0, 12, 14])
    close(rma(ranges(high, low, last), 2), [nan, 2.5, 3.25])


def test_rsi():
    close(rsi(np.array([10.0, 11, 12, 11, 10]), 2), [nan, nan, 100, 50, 25])


def test_rsi_without_moves_is_50():
    assert rsi(np.full(5, 7.0), 2)[-1] == 50


def test_dmi():
    high, low, last = np.array([11.0, 13, 15, 16]), np.array([9.0, 10, 11, 12]), np.array([10.0, 12, 14, 15])
    plus, minus, adx = dmi(high, low, last, 2, 2)
    close(plus[2:], [100 * 2 / 3.25, 100 * 1.5 / 3.625])
    assert minus[2] == 0 and np.isnan(adx[2]) and adx[3] == 100


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_series(n):
    x = np.arange(n, dtype=float)
    for found in (ema(x, 3), rma(x, 3), rsi(x, 3), *dmi(x, x, x, 3, 3)):
        assert len(found) == n


def test_batches_of_a_series_carry_on(spark):
    import datetime as dt

    from tidemill.operators import indicators as I

    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(size=60))
    rows = [(k, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=15 * i), float(c + 1 + i % 3), float(c - 1 - i % 2), float(c)) for k in "xy" for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = I.with_indicators(bars, ["symbol"], 5, 9, 4, 4, 4)
        plan, rows = found._jdf.queryExecution().executedPlan().toString(), found.orderBy("symbol", "ts").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in plan
    high, low = (np.array([r[c] for r in rows[:60]]) for c in ("high", "low"))
    want = [I.ema(close, 5), I.ema(close, 9), I.rma(I.ranges(high, low, close), 4), I.rsi(close, 4), *I.dmi(high, low, close, 4, 4)]
    for name, values in zip(("ema_fast", "ema_slow", "atr", "rsi", "plus_di", "minus_di", "adx"), want, strict=True):
        seen = np.array([np.nan if r[name] is None else r[name] for r in rows])
        assert np.array_equal(seen, np.concatenate([values, values]), equal_nan=True)
