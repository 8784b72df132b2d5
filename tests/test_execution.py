"""The order fold against hand-computed trades."""

from collections import namedtuple

import pytest

from tidemill.operators.execution import Settings, fold

Bar = namedtuple("Bar", "ts open high low close direction stop trigger expiry")
FIXED = Settings(risk_amount=100.0)


def bars(*rows, signal=None):
    out = []
    for i, (o, h, l, c) in enumerate(rows):
        direction, stop, trigger, expiry = (signal or {}).get(i, (None, None, None, None))
        out.append(Bar(i, float(o), float(h), float(l), float(c), direction, stop if stop is not None else float("nan"), trigger if trigger is not None else float("nan"), expiry if expiry is not None else float("nan")))
    return out


def long(i=0):
    return {i: ("LONG", 95.0, None, None)}


@pytest.mark.parametrize(
    ("direction", "stop", "bar", "price", "pnl"),
    [
        ("LONG", 95.0, (100, 111, 99, 105), 110, 200),
        ("LONG", 95.0, (100, 102, 94, 96), 95, -100),
        ("SHORT", 105.0, (100, 101, 89, 95), 90, 200),
        ("SHORT", 105.0, (100, 106, 98, 104), 105, -100),
    ],
)
def test_market_entry(direction, stop, bar, price, pnl):
    (trade,) = fold(bars((100, 101, 99, 100), bar, signal={0: (direction, stop, None, None)}), FIXED)
    assert trade[9] == price and trade[13] == pytest.approx(pnl)


def test_both_touched_counts_the_stop_first():
    (trade,) = fold(bars((100, 101, 99, 100), (100, 111, 94, 100), signal=long()), FIXED)
    assert trade[13] == pytest.approx(-100) and trade[11]


def test_target_first_if_asked():
    (trade,) = fold(bars((100, 101, 99, 100), (100, 111, 89, 100), signal=long()), Settings(risk_amount=100.0, stop_first=False))
    assert trade[13] == pytest.approx(200)


def test_percent_risk_compounds():
    trades = fold(bars((100, 101, 99, 100), (100, 111, 99, 100), (100, 101, 94, 100), signal={0: ("LONG", 95.0, None, None), 1: ("LONG", 95.0, None, None)}), Settings())
    assert [t[7] for t in trades] == pytest.approx([20, 20.4])
    assert [t[15] for t in trades] == pytest.approx([10200, 10098])


def test_pending_long():
    (trade,) = fold(bars((100, 100, 100, 100), (100, 106, 100, 105), (105, 126, 104, 120), signal={0: ("LONG", 95.0, 105.0, 3)}), FIXED)
    assert (trade[4], trade[6], trade[7]) == (105, 125, 10) and trade[13] == pytest.approx(200)


def test_pending_short():
    (trade,) = fold(bars((100, 100, 100, 100), (100, 100, 94, 95), (95, 96, 74, 80), signal={0: ("SHORT", 105.0, 95.0, 3)}), FIXED)
    assert (trade[4], trade[6], trade[7]) == (95, 75, 10) and trade[13] == pytest.approx(200)


def test_pending_expires():
    rows = [(100, 101, 99, 100)] * 3 + [(100, 130, 99, 100)]
    assert fold(bars(*rows, signal={0: ("LONG", 95.0, 105.0, 2)}), FIXED) == []


def test_gap_through_trigger_is_never_resized():
    settings = Settings(risk_amount=100.0, slippage_percent=1.0)
    (trade,) = fold(bars((100, 100, 100, 100), (108, 109, 107.5, 108), (108, 108, 90, 92), signal={0: ("LONG", 95.0, 105.0, 3)}), settings)
    assert trade[4] == pytest.approx(109.08) and trade[7] == pytest.approx(100 / (106.05 - 94.05))


def test_open_beyond_the_stop_fills_at_the_open():
    (trade,) = fold(bars((100, 101, 99, 100), (100, 101, 99, 100), (90, 91, 89, 90), signal=long()), FIXED)
    assert trade[9] == 90 and trade[13] == pytest.approx(-200)


def test_future_bars_do_not_matter():
    rows = [(100, 101, 99, 100), (100, 111, 99, 105), (105, 200, 1, 50)]
    assert fold(bars(*rows[:2], signal=long()), FIXED) == fold(bars(*rows, signal=long()), FIXED)


def test_commission_is_in_the_size():
    settings = Settings(risk_amount=100.0, commission_percent=1.0)
    (trade,) = fold(bars((100, 101, 99, 100), (100, 101, 90, 95), signal=long()), settings)
    assert trade[7] == pytest.approx(100 / (5 + 0.01 * 195)) and trade[13] == pytest.approx(-100)


# --- risk, sizes, lifecycle


def result(**settings):
    return Settings(risk_amount=100.0, **settings)


def test_results_are_measured_in_the_planned_risk():
    (t,) = fold(bars((100, 101, 99, 100), (100, 102, 94, 96), signal=long()), result(slippage_percent=1.0))
    assert (t[4], t[9], t[14], t[12]) == (101, pytest.approx(94.05), pytest.approx(-1), 1)
    (t,) = fold(bars((100, 101, 99, 100), (100, 106, 98, 104), signal={0: ("SHORT", 105.0, None, None)}), result(slippage_percent=1.0))
    assert (t[4], t[9], t[14]) == (99, pytest.approx(106.05), pytest.approx(-1))
    (t,) = fold(bars((100, 101, 99, 100), (100, 101, 99, 100), (90, 91, 89, 90), signal=long()), FIXED)
    assert t[14] == pytest.approx(-2) and t[12] == 2


def test_leverage_caps_the_size_not_the_risk():
    (t,) = fold(bars((100, 101, 99, 100), (100, 100, 99, 99.2), signal={0: ("LONG", 99.5, None, None)}), result(leverage=1.0))
    assert t[7] == 100 and t[18] and t[17] == pytest.approx(50) and t[14] == pytest.approx(-0.5)


@pytest.mark.parametrize(("direction", "stop", "out"), [("LONG", 95.0, 195), ("SHORT", 105.0, 205)])
def test_commissions_count_in_the_size(direction, stop, out):
    (t,) = fold(bars((100, 101, 99, 100), (100, 106, 94, 100), signal={0: (direction, stop, None, None)}), result(commission_percent=1.0))
    assert t[7] == pytest.approx(100 / (5 + 0.01 * out)) and t[14] == pytest.approx(-1)
    (t,) = fold(bars((100, 101, 99, 100), (100, 106, 94, 100), signal={0: (direction, stop, None, None)}), result(commission_percent=1.0, price_distance=True))
    assert t[7] == pytest.approx(20)


def test_gap_through_a_trigger():
    (t,) = fold(bars((100, 100, 100, 100), (108, 109, 107.5, 108), (108, 108, 90, 92), signal={0: ("LONG", 95.0, 105.0, 3)}), result(slippage_percent=1.0))
    assert t[4] == pytest.approx(109.08) and t[22] and t[23] == pytest.approx(3) and t[7] == pytest.approx(100 / (106.05 - 94.05))


def test_orders_that_cannot_be():
    orders = []
    signals = {0: ("LONG", 95.0, 99.0, 2), 1: ("SHORT", 105.0, 101.0, 2), 2: ("LONG", 106.0, 105.0, 2), 3: ("LONG", 95.0, 105.0, 1)}
    fold(bars(*[(100, 101, 99, 100)] * 5, signal=signals), result(), orders=orders)
    assert [o[4] for o in orders] == ["rejected", "rejected", "rejected", "expired"]
    assert [o[6] for o in orders][:3] == ["the trigger is not beyond the close"] * 2 + ["the stop is not beyond the entry"]


def test_least_quantity_and_window():
    assert fold(bars((100, 101, 99, 100), (100, 111, 99, 105), signal=long()), result(min_quantity=50.0)) == []
    rows = bars((100, 101, 99, 100), (100, 101, 99, 100), (100, 111, 99, 105), signal={0: ("LONG", 95.0, None, None), 1: ("LONG", 95.0, None, None)})
    assert [t[2] for t in fold(rows, result(trade_start=1))] == [1]
    assert fold(rows, result(trade_end=0)) == []


def test_a_position_left_open():
    left = []
    assert fold(bars((100, 101, 99, 100), (100, 101, 99, 100), signal=long()), FIXED, still_open=left) == []
    assert left == [("LONG", 0, 1, 100.0, 95.0, 110.0, 20.0, 10000.0)]


def test_explicit_target():
    rows = bars((100, 101, 99, 100), (100, 104, 99, 103))
    (t,) = fold(rows, FIXED, lambda b, slot, balance: ("LONG", 95.0, None, 1, 103.0) if b.ts == 0 else None)
    assert t[9] == 103


def test_spreads_cost():
    quoted = namedtuple("Quoted", "ts open high low close direction stop trigger expiry spread")
    rows = [(100, 100, 100, 100), (100, 106, 100, 105), (105, 126, 104, 120)]
    made = lambda x: [quoted(*b, x) for b in bars(*rows, signal={0: ("LONG", 95.0, 105.0, 3)})]
    (t,) = fold(made(1.0), FIXED)
    assert (t[4], t[6]) == (105, 125)  # the ask reaches the trigger, the bid the target
    assert fold(made(0.0), FIXED)[0][13] == pytest.approx(200)
    short = [quoted(*b, 1.0) for b in bars((100, 100, 99, 100), (100, 100, 94, 95), (95, 96, 74.5, 80), (80, 81, 74, 75), signal={0: ("SHORT", 105.0, 95.0, 3)})]
    (t,) = fold(short, FIXED)
    assert t[8] == 3 and t[9] == 75  # bought back at the ask: 74 and one
    with pytest.raises(ValueError, match="negative"):
        fold(made(-1.0), FIXED)


def test_series_are_folded_as_they_come(spark):
    import datetime as dt

    from tidemill.operators import execution as X

    rows = [(k, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=15 * i), 100.0 + i % 5, 104.0 + i % 7, 97.0 - i % 3, 101.0 + i % 4, "LONG" if i % 6 == 0 else None, 96.0, None, None) for k in "xy" for i in range(50)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, direction string, stop double, trigger double, expiry double")
    want = sorted(map(tuple, X.simulate(bars, ["symbol"], 900).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = X.simulate(bars, ["symbol"], 900)
        assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
        assert want and sorted(map(tuple, found.collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
