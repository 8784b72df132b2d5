"""Decision makers with memory: setups that unfold over several bars, risk locks, and their combination.

A maker is made new for each series. ``decide(bar, slot, balance)`` is called after each bar and gives an order
(direction, stop, trigger, expiry in bars), "CANCEL" or None; ``closed(bar, pnl, balance)`` is called for each closed trade. Bars carry
the columns of ``with_indicators``. Thresholds are fields, so a configuration is an instance's arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def known(*values) -> bool:
    """Whether all values are there (neither None nor nan)."""
    return all(v is not None and v == v for v in values)


class Maker:
    def decide(self, bar, slot: str, balance: float):
        return None

    def closed(self, bar, pnl: float, balance: float) -> None:
        return None


@dataclass
class Pullback(Maker):
    """Trend pullback: in an up trend the low dips to the fast mean; the depth must stay within bounds; a close above
    the prior high ends the pullback and places a stop order. ``sign`` -1 mirrors all of it."""

    sign: int = 1
    adx: float = 15.0
    slope: float | None = None
    body: float | None = None
    shallow: float = 0.2
    deep: float = 3.0
    longest: int = 12
    expiry: int = 3
    buffer: float = 0.05
    stop_buffer: float = 0.2
    active: bool = False
    age: int = 0
    extreme: float = 0.0
    top: float = 0.0
    before: object = None

    def trending(self, bar) -> bool:
        lead = (bar.ema_fast - bar.ema_slow) * self.sign > 0 and bar.adx >= self.adx
        if lead and self.slope is not None and self.before is not None:
            lead = (bar.ema_fast - self.before.ema_fast) * self.sign / bar.atr >= self.slope
        return lead

    def decide(self, bar, slot, balance):
        before, found = self.before, None
        if not known(bar.ema_fast, bar.ema_slow, bar.atr, bar.adx) or bar.atr <= 0 or before is None:
            self.before = bar
            return None
        s = self.sign
        worst, best = (bar.low, bar.high) if s > 0 else (bar.high, bar.low)
        if not self.trending(bar):
            self.active = False
            self.before = bar
            return "CANCEL" if slot == "PENDING" else None
        if slot != "FREE":
            self.active = False
        elif not self.active:
            if (worst - bar.ema_fast) * s <= 0:
                self.active, self.age, self.extreme, self.top = True, 0, worst, before.high if s > 0 else before.low
        else:
            self.age += 1
            self.extreme = min(self.extreme, worst) if s > 0 else max(self.extreme, worst)
            depth = (self.top - self.extreme) * s / bar.atr
            wide = bar.high - bar.low
            strong = self.body is None or (wide > 0 and abs(bar.close - bar.open) / wide <= self.body)
            if self.age > self.longest or depth > self.deep:
                self.active = False
            elif (bar.close - (before.high if s > 0 else before.low)) * s > 0 and depth >= self.shallow and strong:
                trigger, stop = best + s * self.buffer * bar.atr, self.extreme - s * self.stop_buffer * bar.atr
                found = ("LONG" if s > 0 else "SHORT", stop, trigger, self.expiry)
                self.active = False
        self.before = bar
        return found


@dataclass
class Expansion(Maker):
    """Compression, expansion, follow-through: a narrow range of ``width`` bars is left by a wide bar; a further close in
    its direction within a few bars places the order, a close back inside ends the setup."""

    width: int = 12
    narrow: float = 4.0
    wide: float = 1.0
    body: float = 0.4
    follow: int = 3
    expiry: int = 3
    buffer: float = 0.05
    past: list = field(default_factory=list)
    setup: tuple | None = None

    def decide(self, bar, slot, balance):
        found = None
        if known(bar.atr) and bar.atr > 0 and len(self.past) == self.width and slot == "FREE":
            high, low = max(b.high for b in self.past), min(b.low for b in self.past)
            size = bar.high - bar.low
            if self.setup is None:
                strong = size >= self.wide * bar.atr and size > 0 and abs(bar.close - bar.open) / size >= self.body
                if high - low <= self.narrow * bar.atr and strong and (bar.close > high or bar.close < low):
                    sign = 1 if bar.close > high else -1
                    self.setup = (sign, high if sign > 0 else low, bar.low if sign > 0 else bar.high, bar.close, 0)
            else:
                sign, border, stop, last, age = self.setup
                if (bar.close - border) * sign <= 0 or age >= self.follow:
                    self.setup = None
                elif (bar.close - last) * sign > 0:
                    best = bar.high if sign > 0 else bar.low
                    found = ("LONG" if sign > 0 else "SHORT", stop, best + sign * self.buffer * bar.atr, self.expiry)
                    self.setup = None
                else:
                    self.setup = (sign, border, stop, last, age + 1)
        elif slot != "FREE":
            self.setup = None
        self.past = [*self.past, bar][-self.width :]
        return found


@dataclass
class Retest(Maker):
    """Displacement, retest, reclaim, acceptance: a strong close beyond the last extreme (or the last confirmed pivot)
    sets a level; price returns to it, closes back beyond it, and the next bar holds it. A close through the
    displacement's far end destroys the setup."""

    lookback: int = 12
    pivots: bool = False
    strong: float = 1.0
    body: float = 0.5
    near: float = 0.1
    longest: int = 24
    expiry: int = 3
    buffer: float = 0.05
    past: list = field(default_factory=list)
    stage: str = "SEARCH"
    sign: int = 0
    level: float = 0.0
    edge: float = 0.0
    extreme: float = 0.0
    age: int = 0

    def reference(self, sign: int):
        if not self.pivots:
            return max(b.high for b in self.past[-self.lookback :]) if sign > 0 else min(b.low for b in self.past[-self.lookback :])
        for i in range(len(self.past) - 3, 1, -1):
            v = [sign * (b.high if sign > 0 else b.low) for b in self.past[i - 2 : i + 3]]
            if v[2] > v[0] and v[2] > v[1] and v[2] >= v[3] and v[2] >= v[4]:
                return sign * v[2]
        return None

    def decide(self, bar, slot, balance):
        found = None
        if slot != "FREE":
            self.stage = "SEARCH"
        elif known(bar.atr) and bar.atr > 0 and len(self.past) >= self.lookback:
            found = self.advance(bar)
        self.past = [*self.past, bar][-max(self.lookback, 24) :]
        return found

    def advance(self, bar):
        size = bar.high - bar.low
        s = self.sign
        if self.stage == "SEARCH":
            for sign in (1, -1):
                level = self.reference(sign)
                if level is not None and (bar.close - level) * sign > 0 and size >= self.strong * bar.atr and abs(bar.close - bar.open) >= self.body * size and (bar.close - bar.open) * sign > 0:
                    self.stage, self.sign, self.level, self.age = "RETEST", sign, level, 0
                    self.edge = self.extreme = bar.low if sign > 0 else bar.high
                    break
            return None
        self.age += 1
        worst = bar.low if s > 0 else bar.high
        if (bar.close - self.edge) * s < 0 or self.age > self.longest:
            self.stage = "SEARCH"
            return None
        self.extreme = min(self.extreme, worst) if s > 0 else max(self.extreme, worst)
        if self.stage == "RETEST" and (worst - self.level) * s <= self.near * bar.atr:
            self.stage = "RECLAIM"
        if self.stage == "RECLAIM":
            if (bar.close - self.level) * s > 0 and (bar.close - bar.open) * s > 0:
                self.stage = "ACCEPT"
            return None
        if self.stage == "ACCEPT":
            self.stage = "SEARCH"
            if (bar.close - self.level) * s > 0:
                best = bar.high if s > 0 else bar.low
                return "LONG" if s > 0 else "SHORT", self.extreme - s * self.buffer * bar.atr, best + s * self.buffer * bar.atr, self.expiry
        return None


@dataclass
class Locked(Maker):
    """Another maker's orders, unless the day's or month's loss or the run of losses has reached its limit."""

    inner: Maker
    day_percent: float = 2.0
    month_percent: float = 6.0
    losses: int = 4
    day: object = None
    month: object = None
    day_start: float = 0.0
    month_start: float = 0.0
    run: int = 0

    def decide(self, bar, slot, balance):
        day, month = bar.ts.date(), (bar.ts.year, bar.ts.month)
        if day != self.day:
            self.day, self.day_start, self.run = day, balance, 0
        if month != self.month:
            self.month, self.month_start = month, balance
        order = self.inner.decide(bar, slot, balance)
        locked = balance <= self.day_start * (1 - self.day_percent / 100) or balance <= self.month_start * (1 - self.month_percent / 100) or self.run >= self.losses
        return ("CANCEL" if slot == "PENDING" else None) if locked else order

    def closed(self, bar, pnl, balance):
        self.run = self.run + 1 if pnl < -1e-9 else 0 if pnl > 1e-9 else self.run
        self.inner.closed(bar, pnl, balance)


@dataclass
class Combined(Maker):
    """Several makers that share one slot: all see every bar; the first with an order gets the slot, and only the owner of
    a pending order may cancel it."""

    makers: list
    owner: int | None = None

    def decide(self, bar, slot, balance):
        self.owner = None if slot == "FREE" else self.owner
        orders = [m.decide(bar, slot if self.owner in (None, i) else "POSITION", balance) for i, m in enumerate(self.makers)]
        if slot == "PENDING":
            return orders[self.owner] if self.owner is not None and orders[self.owner] == "CANCEL" else None
        if slot == "POSITION":
            return None
        self.owner = next((i for i, o in enumerate(orders) if o and o != "CANCEL"), None)
        return None if self.owner is None else orders[self.owner]

    def closed(self, bar, pnl, balance):
        for m in self.makers:
            m.closed(bar, pnl, balance)


#: Makers by name, each with its parameters' bounds; a configuration outside them is refused.
REGISTRY = {
    "pullback": (Pullback, {"adx": (0, 60), "deep": (0.1, 10), "longest": (1, 100), "expiry": (1, 50)}),
    "expansion": (Expansion, {"width": (3, 100), "wide": (0.1, 5), "follow": (1, 20), "expiry": (1, 50)}),
    "retest": (Retest, {"lookback": (3, 100), "strong": (0.1, 5), "longest": (1, 200), "expiry": (1, 50)}),
}


def configured(name: str, **parameters):
    """A function that makes new makers of that name and those parameters."""
    kind, bounds = REGISTRY[name]
    for k, v in parameters.items():
        if k in bounds and not bounds[k][0] <= v <= bounds[k][1]:
            raise ValueError(f"{name}.{k} = {v} is outside {bounds[k]}")
    return lambda: kind(**parameters)
