"""Backtests of decision makers with memory. SQL cannot express the feedback; tests fix their behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import execution as X
from tidemill.operators import execution_replay as E
from tidemill.operators import machines as K
from tidemill.operators import metrics as M
from tidemill.operators.joins import contained
from tidemill.operators.stored import stored
from tidemill.plans.queries import KEY, SEG, dense_width, prepared_bars, query, ticks


def _simulated(spark, d, machine, output: str = "trades"):
    width = dense_width(spark, d)
    return X.simulate(prepared_bars(spark, d, width), SEG, width, machine=machine, output=output)


@query()
def backtest_pullback(spark, d):
    return _simulated(spark, d, K.configured("pullback", adx=5.0))


@query()
def backtest_expansion(spark, d):
    return _simulated(spark, d, K.configured("expansion", width=6, narrow=8.0, wide=0.3, body=0.1))


@query()
def backtest_retest(spark, d):
    return _simulated(spark, d, K.configured("retest", lookback=3, strong=0.2, body=0.0, near=3.0, expiry=6))


def _core():
    both = K.Combined([K.Pullback(adx=5.0), K.Pullback(sign=-1, adx=5.0), K.Retest(lookback=4, strong=0.3, body=0.1, near=1.0, pivots=True)])
    return K.Locked(both)


@query()
def backtest_core(spark, d):
    return _simulated(spark, d, _core)


@query()
def order_status(spark, d):
    orders = _simulated(spark, d, _core, output="orders")
    return orders.groupBy("direction", "status").agg(F.count("*").alias("orders"))


@query()
def universal_report(spark, d):
    return M.trade_stats(backtest_core(spark, d), ["direction"], r="r")


def _runs(spark, d):
    """All outputs of the combined maker, by series and segment, stored; the bars; their width."""
    width = dense_width(spark, d)
    bars = prepared_bars(spark, d, width)
    return stored(X.runs(bars, SEG, width, machine=_core)), bars, width


@query()
def backtest_rule_counters(spark, d):
    """Signals of each series, taken and not, and what kept them: the funnel of one fold."""
    found, _, _ = _runs(spark, d)
    return X.rule_counters(X.part(found, SEG, "states"), KEY)


@query()
def backtest_bar_states(spark, d):
    """What stood after every bar of the fold."""
    found, _, _ = _runs(spark, d)
    return X.part(found, SEG, "states")


@query()
def backtest_lifecycle(spark, d):
    """Pending orders with times of making, expiry and fill, and the trade that each became."""
    found, _, width = _runs(spark, d)
    orders = X.order_events(X.part(found, SEG, "orders"), width)
    trades = X.part(found, SEG, "trades").select(*SEG, F.col("entry_ts").alias("fill_ts"), F.col("trade_id"), F.col("r"), F.col("reason").alias("exit_reason"))
    return orders.join(trades, [*SEG, "fill_ts"], "left")


@query()
def backtest_enriched(spark, d):
    """Trades with excursions and pending orders' times."""
    found, bars, width = _runs(spark, d)
    return X.enriched(X.part(found, SEG, "trades"), bars, SEG, width)


@query()
def backtest_replay(spark, d):
    """The ambiguous bars of a backtest with stops close to its entries, settled by the events as quotes."""
    width = dense_width(spark, d)
    rows = prepared_bars(spark, d, width)
    sign = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    near = rows.withColumns({"direction": F.when(sign > 0, "LONG").otherwise("SHORT"), "stop": F.col("close") - sign * (F.col("high") - F.col("low")) / 4, "trigger": F.lit(None).cast("double"), "expiry": F.lit(1)})
    found = stored(X.runs(near, SEG, width, X.Settings(reward=1.0), outputs=("trades", "orders")))
    quotes = ticks(spark, d).select(*KEY, "ts", F.col("event_id").alias("seq"), F.col("price").alias("bid"), F.col("price").alias("ask"))
    segments = rows.groupBy(*SEG).agg(F.min("ts").alias("_from"), (F.max("ts") + F.make_dt_interval(secs=F.lit(width))).alias("_to"))
    placed = contained(segments, quotes, KEY, "_from", "_to").filter("ts < _to").drop("_from", "_to")
    tables = E.replay(X.part(found, SEG, "trades"), X.part(found, SEG, "orders"), rows, SEG, width, placed)
    return tables["comparisons"].select(*SEG, "trade_id", "kind", "status", "source", "touched_level", "reason", "replay_reason", "r", "replay_r", "change")
