"""Replays of ambiguous bars against hand-made quotes, and the outputs of one fold."""

import datetime as dt

import pytest

from tidemill.operators import execution as X
from tidemill.operators import execution_replay as E

KEY = ["symbol"]
BAR = dt.datetime(2024, 1, 1, 10)
FOUND = "symbol string, ambiguity_id string, kind string, trade_id long, order_id string, direction string, bar_ts timestamp_ntz, stop double, target double, trigger double, until timestamp_ntz"
TICKS = "symbol string, ts timestamp_ntz, seq long, bid double, ask double"


def at(**more):
    return BAR + dt.timedelta(**more)


def found(spark, kind, direction, stop=None, target=None, trigger=None, trade_id=1):
    return spark.createDataFrame([("A", "x", kind, trade_id, None, direction, BAR, stop, target, trigger, at(minutes=15))], FOUND)


def ticks(spark, *rows):
    return spark.createDataFrame([("A", at(seconds=s), i, float(b), float(a)) for i, (s, b, a) in enumerate(rows)], TICKS)


def lower(spark, *rows):
    bars = spark.createDataFrame([("A", at(minutes=m), float(lo), float(hi)) for m, lo, hi in rows], "symbol string, ts timestamp_ntz, low double, high double")
    return E.lower_quotes(bars, KEY, 0.5)


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(
    ("direction", "stop", "target", "rows", "level"),
    [
        ("LONG", 95.0, 110.0, [(1, 96, 96.5), (2, 94, 94.5)], "stop"),
        ("SHORT", 105.0, 90.0, [(1, 99, 99.5), (2, 104.5, 105.5)], "stop"),
        ("LONG", 95.0, 110.0, [(1, 94, 94.5), (2, 111, 111.5)], "stop"),
        ("LONG", 95.0, 110.0, [(1, 111, 111.5), (2, 94, 94.5)], "target"),
        ("LONG", 95.0, 110.0, [(1, 111, 111.5), (1, 94, 94.5)], "target"),  # one time: the sequence decides
        ("SHORT", 105.0, 90.0, [(1, 89, 89.5), (2, 104.5, 105.5)], "target"),
    ],
)
def test_ticks_tell_which_level_came_first(spark, direction, stop, target, rows, level):
    r = one(E.resolved(found(spark, E.BOTH_LEVELS, direction, stop, target), KEY, ticks(spark, *rows)))
    assert (r["touched_level"], r["quote_side"], r["status"], r["source"]) == (level, "bid", "EXACT_TICK_RESOLUTION", "TICK")


@pytest.mark.parametrize(
    ("stop", "target", "rows", "outcome", "second"),
    [
        (95.0, None, [(1, 99.5, 100.5), (2, 94.5, 95)], "activated_then_stop", "stop"),
        (None, 110.0, [(1, 99.5, 100.5), (2, 110.5, 111)], "activated_then_target", "target"),
        (95.0, None, [(1, 94.5, 95), (2, 99.5, 100.5), (3, 99, 99.5)], "activated_only", None),  # the stop was touched before the entry
    ],
)
def test_pending_entries(spark, stop, target, rows, outcome, second):
    r = one(E.resolved(found(spark, E.PENDING_ENTRY, "LONG", stop, target, 100.0), KEY, ticks(spark, *rows)))
    assert (r["touched_level"], r["outcome"], r["second_level"], r["quote_side"]) == ("trigger", outcome, second, "ask")
    assert r["activation_ts"] == r["event_ts"] and r["resolved_price"] == 100.5


def test_entry_that_quotes_do_not_show(spark):
    rows = found(spark, E.PENDING_ENTRY, "LONG", 95.0, None, 100.0)
    r = one(E.resolved(rows, KEY, ticks(spark, (1, 98, 99))))
    assert (r["status"], r["touched_level"]) == ("FALLBACK_BASELINE_POLICY", "stop")
    r = one(E.resolved(rows, KEY, ticks(spark, (1, 98, 99)), policy="TP_FIRST"))
    assert (r["status"], r["touched_level"]) == ("REPLAY_DATA_INCOMPLETE", None)


def test_lower_bars(spark):
    rows = found(spark, E.BOTH_LEVELS, "LONG", 95.0, 110.0)
    r = one(E.resolved(rows, KEY, lower=lower(spark, (5, 90, 115))))
    assert r["status"] == "STILL_AMBIGUOUS"
    r = one(E.resolved(rows, KEY, lower=lower(spark, (1, 94, 99), (6, 100, 111))))
    assert (r["status"], r["touched_level"], r["source"]) == ("LOWER_TF_RESOLUTION", "stop", "LOWER_TIMEFRAME")
    r = one(E.resolved(rows, KEY, ticks(spark, (1, 100, 101)), lower(spark, (1, 94, 99))))
    assert (r["source"], r["touched_level"]) == ("LOWER_TIMEFRAME", "stop")  # ticks that settle nothing


def test_no_quotes_and_quotes_outside_the_bar(spark):
    rows = found(spark, E.BOTH_LEVELS, "LONG", 95.0, 110.0)
    assert one(E.resolved(rows, KEY))["status"] == "REPLAY_DATA_MISSING"
    other = spark.createDataFrame([("B", BAR, 0, 1.0, 1.0)], TICKS)
    assert one(E.resolved(rows, KEY, other))["status"] == "REPLAY_DATA_MISSING"
    outside = ticks(spark, (-1, 50, 51), (900, 50, 51))
    r = one(E.resolved(rows, KEY, outside))
    assert (r["status"], r["touched_level"], r["resolved_price"]) == ("FALLBACK_BASELINE_POLICY", "stop", 95.0)
    assert one(E.resolved(rows, KEY, outside, policy="TP_FIRST"))["touched_level"] == "target"


TRADES = (
    "symbol string, trade_id long, direction string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, entry double, stop double, target double, exit_ts timestamp_ntz, "
    "exit double, reason string, quantity double, pnl double, r double, risk double, entry_cost double, exit_cost double"
)


def trade(number, out, reason, pnl, r, exit_ts=BAR):
    return ("A", number, "LONG", BAR, BAR, 100.0, 95.0, 110.0, exit_ts, float(out), reason, 1.0, float(pnl), float(r), 5.0, 0.0, 0.0)


@pytest.mark.parametrize(("rows", "change"), [([(1, 94, 94.5), (2, 111, 111.5)], "BASELINE_AMBIGUITY_RESOLVED"), ([(1, 111, 111.5), (2, 94, 94.5)], "OUTCOME_CHANGED")])
def test_changes_of_trades(spark, rows, change):
    trades = spark.createDataFrame([trade(1, 95, "STOP", -5, -1)], TRADES)
    c = one(E.compared(E.resolved(found(spark, E.BOTH_LEVELS, "LONG", 95.0, 110.0), KEY, ticks(spark, *rows)), trades, KEY))
    assert c["change"] == change and (c["exit"], c["pnl"]) == (95.0, -5.0)
    assert c["replay_pnl"] == c["replay_exit"] - 100 and c["replay_r"] == (c["replay_exit"] - 100) / 5
    assert c["replay_exit_ts"] == at(seconds=1) and c["replay_reason"] in ("STOP (tick replay)", "TARGET (tick replay)")


def test_a_whole_replay(spark):
    trades = spark.createDataFrame([trade(1, 110, "TARGET", 10, 2, at(days=5)), trade(2, 95, "STOP", -5, -1)], TRADES)
    bars = spark.createDataFrame([("A", BAR, 90.0, 115.0), ("A", at(minutes=15), 99.0, 111.0), ("A", at(days=5), 99.0, 111.0)], "symbol string, ts timestamp_ntz, low double, high double")
    orders = spark.createDataFrame([("A", at(minutes=-15), BAR, "LONG", 101.0, 95.0, "triggered"), ("A", BAR, at(minutes=15), "LONG", 200.0, 95.0, "expired")], "symbol string, signal_ts timestamp_ntz, end_ts timestamp_ntz, direction string, trigger double, stop double, status string")
    quotes = ticks(spark, (-60, 100, 100.5), (1, 100, 101), (2, 110, 110.5), (60, 94, 94.5))
    tables = E.replay(trades, orders, bars, KEY, 900, quotes)
    kinds = {r["kind"]: r for r in tables["resolutions"].collect()}
    assert set(kinds) == {E.BOTH_LEVELS, E.PENDING_ENTRY}
    assert kinds[E.PENDING_ENTRY]["order_id"] == "2024-01-01T09:45:00-LONG" and kinds[E.PENDING_ENTRY]["trade_id"] == 1  # the first that entered there
    s = one(tables["scenario"])
    assert (s["losers_to_winners"], s["winners_to_losers"], s["changed_trades"]) == (1, 0, 1) and s["pnl_difference"] == pytest.approx(15)
    s = one(tables["sensitivity"])
    assert (s["ambiguous"], s["settled"], s["outcome_changed"], s["settled_percent"]) == (2, 2, 1, 100.0)
    c = one(tables["coverage"])
    assert (c["trades_covered"], c["trades_outside"], c["ambiguities_covered"], c["ambiguities_outside"]) == (1, 1, 2, 0)
    only = E.replay(trades, orders, bars, KEY, 900, quotes, selected=trades.filter("trade_id = 2"))
    assert [r["kind"] for r in only["resolutions"].collect()] == [E.BOTH_LEVELS]
    trace = E.forensic_trace(tables["comparisons"], trades, E.with_span(tables["ambiguities"], bars, KEY, 900), quotes, KEY, E.TICK)
    stages = [r["stage"] for r in trace.filter(f"ambiguity_id like '{E.BOTH_LEVELS}%'").orderBy("stage_no", "ts", "seq").collect()]
    assert stages == ["strategy_signal", "order_creation", *["replay_event"] * 3, "sl_tp_state", "final_resolution"]


def test_bars_closer_than_their_width(spark):
    bars = spark.createDataFrame([("A", BAR), ("A", at(minutes=5)), ("A", at(hours=2))], "symbol string, ts timestamp_ntz")
    rows = found(spark, E.BOTH_LEVELS, "LONG", 95.0, 110.0).drop("until")
    assert one(E.with_span(rows, bars, KEY, 900))["until"] == at(minutes=5)
    assert one(E.with_span(rows, bars.filter("minute(ts) = 0"), KEY, 900))["until"] == at(minutes=15)


def test_malformed_quotes_block(spark):
    with pytest.raises(E.ReplayBlocked, match="chronological"):
        E.tick_quotes(ticks(spark, (2, 1, 1), (1, 1, 1)), KEY)
    with pytest.raises(E.ReplayBlocked, match="malformed"):
        E.tick_quotes(spark.createDataFrame([("A", BAR, 0, None, 1.0)], TICKS), KEY)
    assert E.tick_quotes(ticks(spark, (1, 1, 1), (1, 1, 1), (2, 1, 1)), KEY).count() == 3


def test_gaps(spark):
    bars = spark.createDataFrame([("A", BAR), ("A", at(minutes=15)), ("A", at(hours=1))], "symbol string, ts timestamp_ntz")
    kind = lambda q, s=None: one(E.gaps(bars, q, KEY, 900, s))["gap"]
    from pyspark.sql import functions as F

    assert kind(ticks(spark, (-7200, 1, 1), (7200, 1, 1))) == "REPLAY_DATA_GAP"
    assert kind(ticks(spark, (18000, 1, 1), (21600, 1, 1))) == "MISSING_DATA_GAP"
    assert kind(None) == "MARKET_GAP" and kind(None, F.lit(True)) == "SESSION_GAP"


def test_resuming():
    run = {"baseline": "b", "quotes": "q", "config": {"policy": "SL_FIRST"}}
    assert E.resumable(run, "b", "q", {"policy": "SL_FIRST"}) == run
    with pytest.raises(E.ReplayBlocked, match="baseline changed"):
        E.resumable(run, "c", "q", {"policy": "SL_FIRST"})
    a, b = (E.replay_fingerprint("b", x, "TICK", "TRUE_QUOTE", {}, "1") for x in ("q", "r"))
    assert a != b and a == E.replay_fingerprint("b", "q", "TICK", "TRUE_QUOTE", {}, "1")
    assert E.reserved_warning("HOLDOUT") and E.reserved_warning("DEVELOPMENT") is None


# --- one fold, many outputs


BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, direction string, stop double, trigger double, expiry double, setup string"


def bars_of(spark, *rows):
    return spark.createDataFrame([("A", at(hours=i), *map(float, r[:4]), *(r[4] if len(r) > 4 else (None, None, None, None)), "own") for i, r in enumerate(rows)], BARS)


def test_times_of_signals_follow_the_width_of_bars(spark):
    rows = bars_of(spark, (100, 101, 99, 100, ("LONG", 95.0, None, None)), (100, 111, 99, 105))
    (t,) = X.simulate(rows, KEY, 3600).collect()
    assert t["signal_ts"] == t["entry_ts"] == at(hours=1) and t["setup"] == "own"


def test_nothing_happens_after_the_window(spark):
    flat, order = (100, 101, 99, 100), ("LONG", 95.0, 105.0, 5.0)
    rows = bars_of(spark, (*flat, order), flat, (100, 106, 99, 105), (105, 130, 104, 120))
    ends = lambda end: (X.simulate(rows, KEY, 3600, X.Settings(trade_end=end)).count(), [r["status"] for r in X.simulate(rows, KEY, 3600, X.Settings(trade_end=end), output="orders").collect()])
    assert ends(at(hours=1)) == (0, ["active_at_end"]) and ends(at(hours=2)) == (0, ["triggered"]) and ends(at(hours=3)) == (1, ["triggered"])
    assert X.simulate(rows, KEY, 3600, X.Settings(trade_start=at(hours=1))).count() == 0


def test_one_fold_gives_all_outputs(spark):
    flat = (100, 101, 99, 100)
    rows = bars_of(
        spark, (*flat, ("LONG", 95.0, 105.0, 2.0)), (*flat, ("LONG", 95.0, None, None)), (*flat, ("LONG", 95.0, 105.0, 2.0)),  # expires on this bar, then a new one
        (100, 106, 99, 105), (105, 126, 104, 120, ("LONG", 110.0, 119.0, 2.0)), (*flat, ("LONG", 95.0, None, None)), flat, (*flat, ("SHORT", 105.0, None, None)),
    )
    found = X.runs(rows, KEY, 3600)
    trades, orders, states = (X.part(found, KEY, n) for n in ("trades", "orders", "states"))
    (t,) = trades.collect()
    assert (t["trigger"], t["created_bar"], t["expiry_bar"], t["entry_bar"], t["reason"]) == (105.0, 2, 4, 3, "TARGET")
    assert [(r["status"], r["created_bar"]) for r in orders.filter("trigger is not null").orderBy("signal_ts").collect()] == [("expired", 0), ("triggered", 2), ("rejected", 4)]
    e = X.order_events(orders, 3600).orderBy("signal_ts").collect()
    assert [(r["created_ts"], r["expiry_ts"], r["fill_ts"]) for r in e][:2] == [(at(hours=1), at(hours=2), None), (at(hours=3), at(hours=4), at(hours=3))]
    assert X.part(found, KEY, "open").collect()[0]["direction"] == "LONG"
    s = states.orderBy("ts").collect()
    assert [r["slot"] for r in s] == ["PENDING", "PENDING", "PENDING", "POSITION", "FREE", "PENDING", "POSITION", "POSITION"]
    assert [r["issue"] for r in s] == [None, "an order is waiting", None, None, "refused: the trigger is not beyond the close", None, None, "a position is open"]
    assert s[2]["expired"] and s[3]["opened"] and s[4]["closed"] and s[4]["balance"] > s[3]["balance"]
    (c,) = X.rule_counters(states, KEY).collect()
    assert (c["bars"], c["signals"], c["accepted"], c["ignored"]) == (8, 6, 3, 3) and c["while_open"] + c["while_waiting"] + c["before_window"] + c["refused"] == c["ignored"]
    (r,) = X.enriched(trades, rows, KEY, 3600).collect()
    assert (r["mfe_price"], r["mae_price"], r["mfe_ts"], r["mae_ts"]) == (126.0, 99.0, at(hours=4), at(hours=3)) and r["capture_efficiency"] == pytest.approx(20 / 21)
    assert (r["minutes"], r["entry_model"], r["expiry_ts"], r["stop_distance"]) == (60.0, "STOP_ENTRY_PENDING", at(hours=4), 10.0)


def test_signal_on_the_last_bar(spark):
    (s,) = X.simulate(bars_of(spark, (100, 101, 99, 100, ("LONG", 95.0, None, None))), KEY, 3600, output="states").collect()
    assert s["issue"] == "no bar is left for the entry" and s["accepted"]
