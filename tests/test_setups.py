"""Confirmed hours, regimes and setups."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators import audits as A
from tidemill.operators import execution as X
from tidemill.operators import joins as J
from tidemill.operators import search as V
from tidemill.operators import setups as G

T0 = dt.datetime(2025, 1, 1, 8)

SF = "/root/testdata/sf0.001"


def quarter(spark, closes, start=T0):
    rows = [("x", 0, start + dt.timedelta(minutes=15 * i), c, c + 1.0, c - 1.0, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, segment_id int, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_confirmed_hours(spark):
    rows = quarter(spark, [100.0] * 4 + [101.0] * 4 + [102.0] * 4 + [103.0])
    found = {r["ts"].hour: r for r in G.hour_regime(rows, ["symbol", "segment_id"], 2, 3, 1, 1).collect()}
    assert found[8]["h1_ts"] is None and (found[10]["h1_ts"].hour, found[10]["h1_close"]) == (9, 101)
    assert (found[11]["h1_ts"].hour, found[11]["h1_close"]) == (10, 102) and found[10]["h1_slow"] > found[10]["h1_slow_before"]
    bullish = G.hour_regime(rows, ["symbol", "segment_id"], 2, 3, 1, 1).filter(G.h1_bullish()).select(F.hour("ts")).distinct().collect()
    assert sorted(r[0] for r in bullish) == [10, 11]


REGIME = "h1_fast double, h1_slow double, h1_slow_before double, h1_atr double, ema_fast double, ema_slow double, adx double, atr double"


@pytest.mark.parametrize(
    ("row", "regime", "bucket", "reason"),
    [
        ((12.0, 10.0, 9.0, 1.0, 5.0, 4.0, 20.0, 1.0), "TREND LONG", "BULLISH_TREND", None),
        ((8.0, 10.0, 11.0, 1.0, 4.0, 5.0, 20.0, 1.0), "TREND SHORT", "BEARISH_TREND", None),
        ((10.1, 10.0, 9.0, 1.0, 5.0, 4.0, 10.0, 1.0), "RANGE", "NEUTRAL_RANGE", None),
        ((10.9, 10.0, 9.0, 1.0, 4.0, 5.0, 20.0, 1.0), "CHOP", "TRANSITION", "EMERGING_SEPARATION"),
        ((12.0, 10.0, 9.0, 1.0, 5.0, 4.0, 10.0, 1.0), "CHOP", "TRANSITION", "WIDE_BUT_WEAK_ADX"),
        ((12.0, 10.0, 11.0, 1.0, 5.0, 4.0, 20.0, 1.0), "CHOP", "TRANSITION", "WIDE_BUT_H1_UNALIGNED"),
        ((12.0, 10.0, 9.0, 1.0, 4.0, 5.0, 20.0, 1.0), "CHOP", "TRANSITION", "WIDE_BUT_M15_OPPOSED"),
        ((12.0, 10.0, None, 1.0, 5.0, 4.0, 20.0, 1.0), "CHOP", "WARMUP", None),
    ],
)
def test_regimes(spark, row, regime, bucket, reason):
    found = spark.createDataFrame([row], REGIME).select(G.classify_regime(), G.market_bucket(), G.transition_reason()).first()
    assert tuple(found) == (regime, bucket, reason)


BAR = REGIME + ", h1_close double, rsi double, open double, high double, low double, close double, prev_high_5 double, prev_low_5 double, prev_high_8 double, prev_low_8 double, low_2 double, high_2 double, since_touch int"
UP = (12.0, 10.0, 9.0, 1.0, 100.0, 99.0, 20.0, 1.0, 12.5, 60.0)
DOWN = (8.0, 10.0, 11.0, 1.0, 99.0, 100.0, 20.0, 1.0, 7.5, 40.0)
QUIET = (10.1, 10.0, 9.0, 1.0, 100.0, 99.0, 10.0, 1.0, 10.0, 40.0)


@pytest.mark.parametrize(
    ("kind", "row", "expected"),
    [
        ("breakout", (*UP, 100.0, 101.5, 99.9, 101.4, 101.0, 98.0, 102.0, 97.0, 99.9, 101.5, 1), ("breakout", "LONG", 101.55, 99.7)),
        ("breakout", (*UP, 100.0, 101.5, 99.9, 101.4, 101.4, 98.0, 102.0, 97.0, 99.9, 101.5, 1), None),
        ("breakout", (*DOWN, 99.0, 99.1, 97.5, 97.6, 101.0, 98.0, 102.0, 97.0, 97.5, 99.1, 1), ("breakout", "SHORT", 97.45, 99.3)),
        ("pullback", (*UP, 99.5, 100.5, 99.0, 100.3, 105.0, 95.0, 106.0, 94.0, 99.0, 101.0, 3), ("pullback", "LONG", 100.55, 98.8)),
        ("pullback", (*UP, 99.5, 100.5, 99.0, 100.3, 105.0, 95.0, 106.0, 94.0, 99.0, 101.0, 8), None),
        ("regime", (*QUIET, 97.0, 98.0, 96.5, 97.8, 105.0, 95.0, 106.0, 97.0, 96.5, 98.0, None), ("range", "LONG", 98.05, 96.3)),
        ("combined", (*UP, 100.0, 101.5, 99.9, 101.4, 101.0, 98.0, 102.0, 97.0, 99.9, 101.5, 1), ("pullback", "LONG", 101.55, 99.7)),
    ],
)
def test_setups(spark, kind, row, expected):
    found = G.with_setup(spark.createDataFrame([row], BAR), kind).first()
    got = None if found["direction"] is None else (found["setup"], found["direction"], round(found["trigger"], 6), round(found["stop"], 6))
    assert got == expected


def test_breakout_short_has_no_longs_or_ranges(spark):
    rows = [(*UP, 100.0, 101.5, 99.9, 101.4, 101.0, 98.0, 102.0, 97.0, 99.9, 101.5, 1), (*QUIET, 97.0, 98.0, 96.5, 97.8, 105.0, 95.0, 106.0, 97.0, 96.5, 98.0, None)]
    assert G.with_setup(spark.createDataFrame(rows, BAR), "regime", G.BREAKOUT_SHORT).filter("direction is not null").count() == 0


def test_pooled_results_fall_as_spreads_grow(spark):
    rows = quarter(spark, [100.0] * 3).drop("open", "high", "low", "close")
    prices = spark.createDataFrame([(T0 + dt.timedelta(minutes=15 * i), *p) for i, p in enumerate([(100.0, 100.0, 100.0, 100.0), (100.0, 106.0, 99.0, 105.0), (105.0, 106.0, 90.0, 92.0)])], "ts timestamp_ntz, open double, high double, low double, close double")
    first = F.col("ts") == F.lit(T0).cast("timestamp_ntz")
    signals = rows.join(prices, "ts").withColumns({"direction": F.when(first, "LONG"), "stop": F.when(first, 95.0), "trigger": F.when(first, 105.5), "expiry": F.lit(3)})
    found = X.simulate(X.spread_grid(signals, [0.0, 1.0, 2.0]), ["symbol", "segment_id", "spread"], 900, X.Settings(risk_amount=100.0, reward=3.0)).orderBy("spread").collect()
    assert [r["signal_ts"] for r in found] == [T0 + dt.timedelta(minutes=15)] * 3 and [r["entry"] for r in found] == [105.5] * 3
    assert X.simulate(signals, ["symbol", "segment_id"], 900, output="open").count() == 0


def test_gap_classes_and_freshness(spark):
    day = lambda n: F.lit(dt.datetime(2025, 1, n))
    row = spark.range(1).select(
        A.gap_class(day(1), F.lit(None).cast("timestamp")), A.gap_class(day(1), day(1)), A.gap_class(day(1), day(2), session=F.lit(True)), A.gap_class(day(2), day(3), 900, day(1), day(4)),
        A.gap_class(day(1), day(3), 900, day(2), day(4)), A.gap_class(day(1), day(3)), A.freshness(day(1), day(1)), A.freshness(day(1), day(2)), A.freshness(F.lit(None).cast("timestamp"), day(1)),
        A.freshness(day(1), day(1), F.lit(True)), A.freshness(day(1), day(1), F.lit(True), day(1)), A.freshness(day(1), day(2), F.lit(True), day(1)), A.freshness(F.lit(None).cast("timestamp"), day(1), F.lit(True)),
    ).first()
    assert list(row) == ["MARKET_GAP", "NOT_A_GAP", "SESSION_GAP", "REPLAY_DATA_GAP", "MISSING_DATA_GAP", "MARKET_GAP", "HISTORICAL SNAPSHOT", "HISTORICAL \u00b7 STALE", "NO DATA",
                         "LIVE CLOCK UNAVAILABLE", "LIVE", "STALE LIVE FEED", "NOT CONNECTED"]


def test_parent_bar_within_one_interval(spark):
    at = lambda h, m, s=0: dt.datetime(2025, 1, 1, h, m, s)
    bars = spark.createDataFrame([("x", at(10, 0), 1), ("x", at(10, 15), 2)], "symbol string, ts timestamp_ntz, v int")
    quotes = spark.createDataFrame([("x", at(10, 0)), ("x", at(10, 14, 59)), ("x", at(10, 15)), ("x", at(12, 0)), ("y", at(10, 0))], "symbol string, ts timestamp_ntz")
    found = {(r["symbol"], r["ts"]): r["asof_v"] for r in J.asof_backward(quotes, bars, ["symbol"], "v", within=900).collect()}
    assert found == {("x", at(10, 0)): 1, ("x", at(10, 14, 59)): 1, ("x", at(10, 15)): 2, ("x", at(12, 0)): None, ("y", at(10, 0)): None}


def test_folds_have_no_cap_and_streaks_are_exact(spark):
    assert V.folds(spark, "1900-01-01", "2020-01-01", 1, 1).count() == 1439
    assert V.bootstrap(spark, [-1.0, -1.0, 1.0, -1.0], 5, permute=True).filter("losing_streak between 1 and 3").count() == 5
    with pytest.raises(ValueError, match="more than"):
        V.bootstrap(spark, [0.0] * (V.MOST_RESULTS + 1), 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["setup_breakout", "setup_pullback", "setup_regime", "setup_breakout_short", "setup_combined", "backtest_setups", "backtest_next_open"])
def test_queries_show_what_they_claim(spark, name):
    from tidemill.plans import machines, setups  # noqa: F401  register their queries
    from tidemill.plans.queries import Q

    rows = Q[name](spark, SF).collect()
    assert rows
    if name.startswith("setup_"):
        sides = {r["direction"] for r in rows}
        assert sides == ({"SHORT"} if name == "setup_breakout_short" else {"LONG", "SHORT"})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_regime_is_reached(spark):
    from tidemill.plans import setups

    found = setups.hour_regimes(spark, "/root/testdata/sf0.01").collect()
    # the walk of these tables falls; on ten times as many events BULLISH_TREND is reached too
    assert {r["bucket"] for r in found} >= {"WARMUP", "BEARISH_TREND", "NEUTRAL_RANGE", "TRANSITION"}
    assert {r["regime"] for r in found} == {"CHOP", "TREND LONG", "TREND SHORT", "RANGE"}
