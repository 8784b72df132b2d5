"""Queries of confirmed-hour regimes and setups, over all events.

Events of a series do not trend, so each is a step of a walk here: quarter-hour bars in order of time, without gaps, whose
closes add up what each event's value differs from the series' mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import execution as X
from tidemill.operators import metrics as M
from tidemill.operators import setups as G
from tidemill.operators.carry import chunked, numbered, running
from tidemill.plans.queries import KEY, SEG, query, ticks

#: Short lengths, so that the tables' segments warm up.
LENGTHS, HOURS = (5, 12, 7, 7, 7), (3, 6, 3, 1)
LOOSE = G.Rules(adx=5.0, body=0.2, size=(0.2, 4.0), long_rsi=(40.0, 90.0), short_rsi=(10.0, 60.0), risk=(0.1, 6.0), sweep=(0.01, 3.0), separation=0.3, sweep_rsi=60.0)


def walk_bars(spark, d):
    events = ticks(spark, d)
    means = events.groupBy(*KEY).agg(F.avg("price").alias("_mean"))
    rows = numbered(events, KEY, ["ts", "event_id"], "n").drop("ts").join(means, KEY).withColumn("_step", (F.col("price") - F.col("_mean")) / 200)
    rows = running(chunked(rows, KEY, ["n"]), KEY, ["n"], sums={"_walk": F.col("_step")}).drop("_chunk")
    rows = rows.withColumns({"close": 1000 + F.col("_walk"), "open": 1000 + F.col("_walk") - F.col("_step")})
    return rows.select(
        *KEY, F.lit(1).cast("long").alias("segment_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("n") * 900)).alias("ts"), "open",
        (F.greatest("open", "close") + F.col("user_id") % 7 * 0.01).alias("high"), (F.least("open", "close") - F.col("user_id") % 5 * 0.01).alias("low"), "close", F.lit(1.0).alias("volume"),
    )


def rows_of(spark, d):
    return G.prepared(walk_bars(spark, d), SEG, LENGTHS, HOURS)


def _signals(spark, d, kind: str, rules: G.Rules = LOOSE):
    found = G.with_setup(rows_of(spark, d), kind, rules).filter("direction is not null")
    return found.select(*SEG, "ts", "setup", "direction", F.round("trigger", 6).alias("trigger"), F.round("stop", 6).alias("stop"), "expiry")


@query()
def hour_regimes(spark, d):
    """Bars and regimes of each series: buckets, reasons of transitions, and the regime of the trend and range rules."""
    rows = rows_of(spark, d).select("symbol", G.market_bucket().alias("bucket"), G.transition_reason().alias("reason"), G.classify_regime().alias("regime"))
    return rows.groupBy("symbol", "bucket", "reason", "regime").agg(F.count("*").alias("bars"))


@query()
def regime_classify(spark, d):
    """Bars of each series in each market regime."""
    return rows_of(spark, d).groupBy("symbol", G.market_bucket().alias("regime")).agg(F.count("*").alias("bars"))


@query()
def setup_breakout(spark, d):
    return _signals(spark, d, "breakout")


@query()
def setup_pullback(spark, d):
    return _signals(spark, d, "pullback")


@query()
def setup_regime(spark, d):
    return _signals(spark, d, "regime")


@query()
def setup_breakout_short(spark, d):
    return _signals(spark, d, "regime", G.Rules(**{**LOOSE.__dict__, "longs": False, "ranges": False}))


@query()
def setup_combined(spark, d):
    return _signals(spark, d, "combined")


@query()
def backtest_setups(spark, d):
    """The combined setup at three spreads, pooled by spread."""
    rows = X.spread_grid(G.with_setup(rows_of(spark, d), "combined", LOOSE), [0.0, 0.05, 0.1])
    return M.trade_stats(X.simulate(rows, [*SEG, "spread"], 900), ["spread"], r="r")
