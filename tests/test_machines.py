"""Decision makers on hand-made bars."""

from collections import namedtuple
import datetime as dt

import pytest

from tidemill.operators import machines as K
from tidemill.operators.execution import Settings, fold

Bar = namedtuple("Bar", "ts open high low close ema_fast ema_slow atr adx")
T0 = dt.datetime(2025, 1, 1)


def bar(i, o, h, low, c, fast=100.0, slow=98.0, atr=1.0, adx=30.0):
    return Bar(T0 + dt.timedelta(minutes=15 * i), float(o), float(h), float(low), float(c), fast, slow, atr, adx)


def test_pullback_places_an_order_after_the_close_above_the_prior_high():
    maker = K.Pullback()
    rows = [bar(0, 101, 102, 100.5, 101.5), bar(1, 101, 101.2, 99.5, 100), bar(2, 100, 101.8, 99.8, 101.6)]
    assert [maker.decide(b, "FREE", 1e4) for b in rows] == [None, None, ("LONG", pytest.approx(99.3), pytest.approx(101.85), 3)]


def test_pullback_ends_with_the_trend_and_cancels():
    maker = K.Pullback()
    maker.decide(bar(0, 101, 102, 100.5, 101.5), "FREE", 1e4)
    assert maker.decide(bar(1, 101, 102, 100.5, 101.5, fast=90.0), "PENDING", 1e4) == "CANCEL"


def test_mirror():
    maker = K.Pullback(sign=-1)
    rows = [bar(0, 99, 99.5, 98, 98.5, fast=100, slow=102), bar(1, 99, 100.5, 98.8, 100, fast=100, slow=102), bar(2, 100, 100.2, 98.2, 98.4, fast=100, slow=102)]
    assert [maker.decide(b, "FREE", 1e4) for b in rows][-1] == ("SHORT", pytest.approx(100.7), pytest.approx(98.15), 3)


def test_expansion_needs_follow_through():
    maker = K.Expansion(width=3)
    rows = [bar(i, 100, 100.5, 99.5, 100) for i in range(3)] + [bar(3, 100, 102, 100, 101.8), bar(4, 101.8, 102.5, 101.5, 102.2)]
    assert [maker.decide(b, "FREE", 1e4) for b in rows][-1] == ("LONG", 100.0, pytest.approx(102.55), 3)
    maker = K.Expansion(width=3)
    assert [maker.decide(b, "FREE", 1e4) for b in [*rows[:4], bar(4, 101, 101, 99, 100)]][-1] is None and maker.setup is None


def test_retest_sequence():
    maker = K.Retest(lookback=3)
    rows = [bar(i, 100, 100.5, 99.5, 100) for i in range(3)]
    rows += [bar(3, 100, 102, 100, 101.8), bar(4, 101.5, 101.6, 100.4, 100.9), bar(5, 100.6, 101.2, 100.5, 101.1), bar(6, 101, 101.4, 100.8, 101.2)]
    found = [maker.decide(b, "FREE", 1e4) for b in rows]
    assert found[:-1] == [None] * 6 and found[-1][0] == "LONG" and found[-1][2] == pytest.approx(101.45)


def test_locks_after_losses():
    class Always(K.Maker):
        def decide(self, b, slot, balance):
            return ("LONG", b.close - 1, None, 1) if slot == "FREE" else None

    rows = [bar(i, 100, 100.2, 90, 100) for i in range(10)]
    locked = K.Locked(Always(), losses=2, day_percent=50.0, month_percent=50.0)
    assert len(fold(rows, Settings(), locked.decide, locked.closed)) == 2


def test_combined_gives_the_slot_to_the_first():
    class One(K.Maker):
        def __init__(self, name, at):
            self.name, self.at, self.n = name, at, -1

        def decide(self, b, slot, balance):
            self.n += 1
            return (self.name, 1.0, 2.0, 1) if self.n in self.at and slot == "FREE" else None

    both = K.Combined([One("LONG", [1]), One("SHORT", [0, 1])])
    assert [both.decide(bar(i, 1, 1, 1, 1), "FREE", 1.0)[0] for i in range(2)] == ["SHORT", "LONG"]


def test_orders_have_an_end():
    class Pending(K.Maker):
        def decide(self, b, slot, balance):
            return ("LONG", 95.0, 105.0, 2) if slot == "FREE" else None

    orders = []
    fold([bar(i, 100, 101, 99, 100) for i in range(6)], Settings(), Pending().decide, None, orders)
    assert [o[4] for o in orders] == ["expired", "expired", "active_at_end"]


def test_bounds():
    with pytest.raises(ValueError, match="outside"):
        K.configured("pullback", expiry=0)
