"""Contract arithmetic, order and replay classes, matching of signals and trades."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.functions import broker as K
from tidemill.operators import research as Z

GOLD = K.Contract(tick_size=0.01, tick_value=1.0, minimum_volume=0.01, volume_step=0.01, maximum_volume=50.0, point=0.01, stops_level=100)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_contract(spark):
    long, short = F.lit("LONG"), F.lit("SHORT")
    entry, stop = F.lit(2000.0), F.lit(1990.0)
    assert one(spark, K.stop_fault(entry, stop, long, GOLD)) is None
    assert one(spark, K.stop_fault(entry, stop, short, GOLD)) == "wrong side"
    assert one(spark, K.stop_fault(entry, F.lit(1999.5), long, GOLD)) == "too near"
    assert one(spark, K.loss_per_lot(entry, stop, long, GOLD, F.lit(0.5), 7.0)) == pytest.approx(1057)
    assert one(spark, K.loss_per_lot(entry, stop, short, GOLD, F.lit(0.5))) is None
    assert one(spark, K.pnl_from_prices(entry, F.lit(2003.0), short, F.lit(2.0), GOLD)) == pytest.approx(-600)
    assert one(spark, K.margin_required(F.lit(2.0), F.lit(0.0))) is None
    assert one(spark, K.lot_size(F.lit(10_000.0), 1.0, entry, stop, long, GOLD, F.lit(0.0))) == pytest.approx(0.1)
    assert one(spark, K.lot_size(F.lit(10_000.0), 1.0, entry, stop, long, GOLD, F.lit(0.0), margin_per_lot=500_000.0)) == pytest.approx(0.02)
    assert one(spark, K.lot_size(F.lit(1.0), 1.0, entry, stop, long, GOLD, F.lit(0.0))) is None
    assert one(spark, K.normalised_price(F.lit(2000.129), GOLD)) == 2000.13
    assert one(spark, K.normalised_price(F.lit(-1.0), GOLD)) is None


def test_quotes(spark):
    bar = spark.createDataFrame([(9.0, 12.0, 9.5, 12.5)], "bid_low double, bid_high double, ask_low double, ask_high double")

    def leave(direction, stop, target, first=True):
        row = bar.select(K.quote_exit(F.lit(direction), F.lit(stop), F.lit(target), first).alias("v")).first()["v"]
        return row and tuple(row)

    assert leave("LONG", 9.0, 20.0) == (9.0, "stop") and leave("LONG", 8.0, 12.0) == (12.0, "target")
    assert leave("LONG", 9.0, 12.0) == (9.0, "stop") and leave("LONG", 9.0, 12.0, False) == (12.0, "target")
    assert leave("SHORT", 12.5, 1.0) == (12.5, "stop") and leave("SHORT", 13.0, 9.0) is None
    sides = [one(spark, K.quote_side(F.lit(d), F.lit(e))) for d in ("LONG", "SHORT") for e in ("entry", "pending_trigger", "close", "stop_target", "other")]
    assert sides == ["ask", "ask", "bid", "bid", None, "bid", "bid", "ask", "ask", None]
    assert one(spark, K.quote_price(F.lit(2.0), F.lit(1.0), F.lit("LONG"), F.lit("entry"))) is None
    assert [one(spark, K.timeframe_label(F.lit(x).cast("double"))) for x in (15.0, 2.5, None)] == ["15 Minutes", "2.50 Minutes", "Unknown"]


def test_classes(spark):
    def order(a, b, at=0, bt=0, ap=1.0, bp=1.0):
        return one(spark, K.order_class(*[F.lit(x).cast("string") for x in (a, b)], F.lit(at), F.lit(bt), F.lit(ap), F.lit(bp), 0.1))

    assert order(None, "triggered") == "SYNTHETIC_ONLY_FILL" and order("triggered", "expired") == "ORIGINAL_ONLY_FILL"
    assert order("triggered", "triggered", 1, 2) == "TIMING_CHANGED_FILL" and order("triggered", "triggered", ap=2.0) == "PRICE_CHANGED_FILL"
    assert order("triggered", "triggered") == "SAME_FILL" and order("expired", "expired") == "EXPIRED_BOTH"
    assert order("cancelled", "cancelled") == "CANCELED_BOTH" and order("expired", "cancelled") == order(None, None) == "OTHER_ORDER_STATE"
    base = dict(entry_price=1.0, entry_time=1, pnl=5.0, exit_price=2.0, exit_reason="Take profit", exit_time=9, entry_commission=0.1, exit_commission=0.1)

    def replay(status="RESOLVED", touched=None, **other):
        a, b = ({k: F.lit(v) for k, v in x.items()} for x in (base, base | other))
        return one(spark, K.replay_class(F.lit(status), F.lit(touched).cast("string"), a, b))

    assert replay("REPLAY_DATA_MISSING") == "STILL_AMBIGUOUS" and replay("NOT_AMBIGUOUS", exit_price=3.0) == "IDENTICAL"
    assert replay(entry_price=1.5) == "ENTRY_CHANGED" and replay(pnl=-1.0) == "OUTCOME_CHANGED"
    assert replay(touched="target", exit_price=2.1) == "BASELINE_AMBIGUITY_RESOLVED" and replay(exit_price=2.1) == "EXIT_CHANGED"
    assert replay(exit_time=8) == "TIMING_CHANGED" and replay(exit_commission=0.2) == "COST_CHANGED" and replay() == "IDENTICAL"


def test_signal_and_trade_match(spark):
    def at(minutes):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)

    schema = "ts timestamp_ntz, direction string, id long"
    left = spark.createDataFrame([(at(0), "LONG", 1), (at(30), "LONG", 2), (at(90), "SHORT", 3), (at(300), "LONG", 4)], schema)
    right = spark.createDataFrame([(at(0), "LONG", 11), (at(45), "LONG", 12), (at(90), "LONG", 13), (at(600), "SHORT", 14)], schema)
    pairs = Z.signal_match(left, right)
    assert {tuple(x) for x in pairs.collect()} == {
        (1, 11, "EXACT"), (2, 12, "NEAR"), (3, 13, "OPPOSITE"), (4, None, "LEFT_ONLY"), (None, 14, "RIGHT_ONLY"),
    }
    a = spark.createDataFrame([(1, 5.0, 100.0)], "id long, pnl double, entry double")
    b = spark.createDataFrame([(11, -2.0, 99.0)], "id long, pnl double, entry double")
    row = Z.trade_match(pairs, a, b).first()
    assert (row["outcome"], row["entry_gap"]) == ("left win / right loss", 1.0)
    assert Z.trade_match(pairs, a.limit(0), b).first()["outcome"] == "not both completed"


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    b = spark.createDataFrame([(1, "c"), (3, "d")], "k long, y string")
    assert [tuple(x) for x in Z.one_to_one(a, b, ["k"]).collect()] == [(1, "a", "c")]
    with pytest.raises(Exception, match="a key occurs twice"):
        Z.one_to_one(a.union(a), b, ["k"]).collect()


def test_fill_quality(spark):
    rows = spark.createDataFrame([("LONG", 0, 0, 10.0, 9.0, 5.0), ("SHORT", 0, 900, 8.0, 8.0, -1.0), ("LONG", 0, 1800, 8.0, 8.0, 1.0)], "direction string, s long, e long, open double, trigger double, pnl double")
    bar = K.fill_bar(F.timestamp_seconds("s"), F.timestamp_seconds("e"), 900)
    found = {(x["fill"], x["side"]): (x["trades"], x["net"]) for x in Z.fill_quality(rows, bar, K.gap_fill(F.col("direction"), F.col("open"), F.col("trigger"))).collect()}
    assert found[("B+1", "Long")] == (1, 5.0) and found[("B+2", "All")] == (1, -1.0) and ("B+2", "Long") not in found
    assert found[("Gap-through-trigger", "All")] == (1, 5.0) and found[("Normal", "All")] == (2, 0.0)


def test_greedy_match_equals_a_plain_walk(spark):
    import datetime as dt
    import random

    from tidemill.operators.compare import greedy_match

    rng, day = random.Random(8), dt.datetime(2024, 1, 1)
    sides = [[(rng.choice("ab"), day + dt.timedelta(seconds=rng.choice([1, 30, 600]) * rng.randrange(60)), i) for i in range(150)] for _ in range(2)]
    left, right = (spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long") for rows in sides)
    for tolerance in (0, 5, 40, 900):
        want = []
        for key in "ab":
            free = sorted((t, i) for k, t, i in sides[1] if k == key)
            for t, i in sorted((t, i) for k, t, i in sides[0] if k == key):
                near = [(abs((t - u).total_seconds()), u, j) for u, j in free if abs((t - u).total_seconds()) <= tolerance]
                if near:
                    gap, u, j = min(near)
                    free.remove((u, j))
                    want.append((key, i, j, int(gap)))
        assert sorted(map(tuple, greedy_match(left, right, ["k"], tolerance).collect())) == sorted(want)
    assert greedy_match(left, right.filter("false"), ["k"], 5).count() == 0
