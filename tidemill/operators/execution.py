"""Order simulation: an ordered fold over the bars of one series and configuration.

Account state feeds back into sizes and slots, so no window can express it; Spark deals the (configuration, segment)
groups and each is folded in order. Bars come with their signals as columns: ``direction`` (LONG or SHORT, null for
none), ``stop``, and for pending entries ``trigger`` and ``expiry`` (bars). One position or pending order exists at a time.

Order of events on a bar: fill a market order at the open, or try the pending order (expired beyond its last bar);
then the exit of an open position, on the entry bar too; then the bar's own signal, if the slot is free. A gap in time
cancels a pending order and ends an open position's series (groups are continuous segments, so it cannot occur inside).
If one bar touches stop and target, the stop counts first. An open beyond the stop fills at the open; an open beyond the
target fills at the target.

A signal is known when its bar has closed: its time is the bar's open time and one step, which is the width of the bars
that were given. A pending trigger must lie beyond
that close. Sizes come from a risk budget, which is also what results are measured in (``r``): a gap or a capped size
changes the result, not the budget. A ``spread`` column makes bars bids: buying (LONG entries, SHORT exits) goes by the
ask, the bid and the bar's spread; signals always go by the bid.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.operators.joins import contained


@dataclass(frozen=True)
class Settings:
    """Money management and costs, in percent of balance or price. ``price_distance`` sizes by the distance from entry to
    stop alone; otherwise slippage and commissions at the stop count too. ``trade_start`` and ``trade_end`` are times of
    bars, both included: signals before the start are ignored, and bars after the end are not looked at, so nothing is
    entered before the one or left after the other."""

    initial: float = 10_000.0
    risk_percent: float = 1.0
    risk_amount: float | None = None
    reward: float = 2.0
    commission_percent: float = 0.0
    slippage_percent: float = 0.0
    leverage: float | None = None
    stop_first: bool = True
    price_distance: bool = False
    min_quantity: float = 0.0
    trade_start: object = None
    trade_end: object = None

    def __post_init__(self):
        if not (self.initial > 0 and self.reward > 0 and self.risk_percent > 0 and (self.risk_amount is None or self.risk_amount > 0)):
            raise ValueError("balance, risk and reward must be positive")
        if not (0 <= self.commission_percent < 100 and 0 <= self.slippage_percent < 100 and self.min_quantity >= 0 and (self.leverage is None or self.leverage > 0)):
            raise ValueError("costs must be from 0 to 100 percent, leverage positive, and the least quantity not negative")


TRADE = (
    "trade_id long, direction string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, entry double, stop double, target double, quantity double, "
    "exit_ts timestamp_ntz, exit double, reason string, ambiguous boolean, bars_held long, pnl double, r double, balance double, "
    "risk double, estimated_loss double, capped boolean, entry_cost double, exit_cost double, return_percent double, gap_entry boolean, entry_gap double, "
    "setup string, trigger double, created_bar long, expiry_bar long, entry_bar long"
)


class Refused(ValueError):
    """An order that cannot be opened."""


def slipped(price: float, buying: bool, s: Settings) -> float:
    return price * (1 + s.slippage_percent / 100 if buying else 1 - s.slippage_percent / 100)


def sized(balance: float, entry: float, stop: float, long: bool, s: Settings) -> dict:
    """Quantity, risk budget and estimated loss at the stop, for a slipped entry."""
    sign = 1 if long else -1
    distance = sign * (entry - stop)
    if not (entry > 0 and stop > 0 and distance > 0):
        raise Refused("the stop is not beyond the entry")
    budget = s.risk_amount if s.risk_amount is not None else balance * s.risk_percent / 100
    out = slipped(stop, not long, s)
    loss = sign * (entry - out) + s.commission_percent / 100 * (entry + out)
    if budget <= 0 or loss <= 0:
        raise Refused("no risk budget")
    quantity = budget / (distance if s.price_distance else loss)
    most = balance * s.leverage / entry if s.leverage else quantity
    if most <= 0:
        raise Refused("no exposure is left")
    capped, quantity = quantity > most, min(quantity, most)
    if quantity < s.min_quantity:
        raise Refused("below the least quantity")
    return {"quantity": quantity, "risk": budget, "loss": quantity * loss, "capped": capped}


def exit_of(bar, position: dict, s: Settings, opened_inside: bool):
    """(price, reason, ambiguous) where a bar, as its side of the quote, ends a position, else None."""
    long, stop, target = position["long"], position["stop"], position["target"]
    sign = 1 if long else -1
    adverse, favourable = (bar.low, bar.high) if long else (bar.high, bar.low)
    if not opened_inside:
        if sign * (stop - bar.open) >= 0:
            return bar.open, "STOP_GAP", False
        if sign * (bar.open - target) >= 0:
            return target, "TARGET_GAP", False
    hit_stop, hit_target = sign * (stop - adverse) >= 0, sign * (favourable - target) >= 0
    if hit_stop and (s.stop_first or not hit_target):
        return stop, "STOP", hit_target
    if hit_target:
        return target, "TARGET", hit_stop
    return None


def by_columns(bar, slot: str, balance: float):
    """The bar's own signal: (direction, stop, trigger, expiry), or None."""
    if bar.direction not in ("LONG", "SHORT") or bar.stop is None or bar.stop != bar.stop:
        return None
    trigger = None if bar.trigger is None or bar.trigger != bar.trigger else bar.trigger
    expiry = 1 if bar.expiry is None or bar.expiry != bar.expiry else int(bar.expiry)
    target = getattr(bar, "target", None)
    return bar.direction, bar.stop, trigger, expiry, None if target != target else target


Quote = namedtuple("Quote", "open high low close")


def quote(bar, buying: bool) -> Quote:
    """The bar's bid, or its ask where one buys."""
    more = (getattr(bar, "spread", 0.0) or 0.0) if buying else 0.0
    if not more >= 0:
        raise ValueError("spreads must not be negative")
    return Quote(bar.open + more, bar.high + more, bar.low + more, bar.close + more)


def opened(order: dict, base: float, ts, s: Settings) -> dict:
    """The position of an order that fills at ``base``, before slippage. A pending order keeps its size."""
    long, sign = order["long"], 1 if order["long"] else -1
    entry = slipped(base, long, s)
    money = order if "quantity" in order else sized(order["balance"], entry, order["stop"], long, s)
    distance = sign * (entry - order["stop"])
    if distance <= 0:
        raise Refused("the stop is not beyond the fill")
    target = order.get("target")
    target = entry + sign * s.reward * distance if target is None else target
    if not (target > 0 and sign * (target - entry) > 0):
        raise Refused("the target is not beyond the entry")
    return order | money | {"entry": entry, "target": target, "entry_ts": ts, "held": 1, "cost": entry * money["quantity"] * s.commission_percent / 100}


def closing(position: dict, ts, found: tuple, number: int, balance: float, s: Settings) -> tuple:
    """A trade, a row of ``TRADE``."""
    price, reason, ambiguous = found
    long, sign, quantity = position["long"], 1 if position["long"] else -1, position["quantity"]
    out = slipped(price, not long, s)
    cost = out * quantity * s.commission_percent / 100
    pnl = sign * (out - position["entry"]) * quantity - position["cost"] - cost
    return (
        number, "LONG" if long else "SHORT", position["signal_ts"], position["entry_ts"], position["entry"], position["stop"], position["target"],
        quantity, ts, out, reason, ambiguous, position["held"], pnl, pnl / position["risk"], balance + pnl,
        position["risk"], position["loss"], position["capped"], position["cost"], cost, pnl / (position["entry"] * quantity) * 100,
        position.get("gap", 0.0) > 0, position.get("gap", 0.0),
        position.get("setup"), position.get("trigger"), position["created"], position["expiry"], position["bar"],
    )


def fold(
    bars, s: Settings, decide=by_columns, closed=None, orders: list | None = None, still_open: list | None = None, states: list | None = None
) -> list[tuple]:
    """Trades of one ordered series of bars.

    ``decide(bar, slot, balance)`` gives an order, "CANCEL" or None after each bar; ``slot`` is FREE, PENDING or POSITION, and
    orders count only in a free slot. An order is (direction, stop, trigger or None, bars to expiry) and, for market
    orders, maybe a target. ``closed(bar, pnl, balance)`` hears of each closed trade. ``orders`` gets a row of ``ORDER`` for
    each order that ends, ``still_open`` the position that the series leaves (``OPEN``), and ``states`` a row of ``STATE`` for
    each bar: what happened on it, what stands after it, and why a signal came to nothing."""
    balance, position, pending, market, trades, last = s.initial, None, None, None, [], None

    def ended(order: dict, ts, status: str, reason: str | None = None, price: float | None = None) -> None:
        if orders is not None:
            side = "LONG" if order["long"] else "SHORT"
            own = (order["created"], order["expiry"], order["setup"])
            orders.append((order["signal_ts"], ts, side, order.get("trigger"), status, order["stop"], reason, price, *own))

    rows = bars if s.trade_end is None else (bar for bar in bars if bar.ts <= s.trade_end)
    for number, bar in enumerate(rows):
        inside, last, happened, issue = False, bar, set(), None
        if position is not None:
            position["held"] += 1
        order, market = market or pending, None
        if order is not None:
            side, long, trigger = quote(bar, order["long"]), order["long"], order.get("trigger")
            touched = trigger is None or (side.high >= trigger if long else side.low <= trigger)
            if touched:
                base = side.open if trigger is None else max(trigger, side.open) if long else min(trigger, side.open)
                gap = 0.0 if trigger is None else abs(base - trigger)
                pending = None
                try:
                    position = opened(order, base, bar.ts, s) | {"gap": gap, "bar": number}
                    inside = trigger is not None and not gap and side.open != trigger
                    ended(order, bar.ts, "triggered", None, position["entry"])
                    happened.add("opened")
                except Refused as e:
                    ended(order, bar.ts, "rejected" if trigger is None else "cancelled", str(e))
                    issue = f"refused at its fill: {e}"
            elif number >= order["expiry"]:
                ended(order, bar.ts, "expired", "not triggered by the end of its last bar")
                happened.add("expired")
                pending = None
        if position is not None and (found := exit_of(quote(bar, not position["long"]), position, s, inside)):
            trades.append(closing(position, bar.ts, found, len(trades) + 1, balance, s))
            pnl, balance, position = trades[-1][13], trades[-1][15], None
            happened.add("closed")
            if closed:
                closed(bar, pnl, balance)
        slot = "POSITION" if position else "PENDING" if pending else "FREE"
        order = decide(bar, slot, balance)
        signal = order[0] if order and order != "CANCEL" else None
        if s.trade_start is not None and bar.ts < s.trade_start:
            issue = "before the trade window" if order else issue
        elif order == "CANCEL":
            if pending:
                ended(pending, bar.ts, "cancelled", "by its maker")
                happened.add("cancelled")
                pending = None
            else:
                issue = "no order to cancel"
        elif order and slot != "FREE":
            issue = "a position is open" if position else "an order is waiting"
        elif order:
            direction, stop, trigger, expiry, *target = order
            made = {
                "long": direction == "LONG", "stop": stop, "signal_ts": bar.ts, "balance": balance, "created": number,
                "expiry": number + (expiry or 1), "setup": getattr(bar, "setup", None),
            }
            if trigger is None:
                market = made | {"target": target[0] if target else None}
            else:
                made["trigger"] = trigger
                try:
                    if (trigger - bar.close) * (1 if made["long"] else -1) <= 0:
                        raise Refused("the trigger is not beyond the close")
                    pending = made | sized(balance, slipped(trigger, made["long"], s), stop, made["long"], s)
                except Refused as e:
                    ended(made, bar.ts, "rejected", str(e))
                    issue = f"refused: {e}"
        if states is not None:
            held, waits = position or {}, pending or market or {}
            sides = tuple(None if not x else "LONG" if x["long"] else "SHORT" for x in (held, waits))
            states.append((
                bar.ts, number, balance, "POSITION" if position else "PENDING" if waits else "FREE", signal, bool(signal) and waits.get("created") == number,
                *(x in happened for x in ("opened", "closed", "expired", "cancelled")), issue, sides[0], *map(held.get, ("entry", "stop", "target", "quantity", "held")),
                sides[1], *map(waits.get, ("trigger", "stop", "expiry")),
            ))
    if pending is not None:
        ended(pending, last.ts, "active_at_end", "the data ended before")
    if states and market is not None:
        states[-1] = (*states[-1][:10], "no bar is left for the entry", *states[-1][11:])
    if position is not None and still_open is not None:
        still_open.append(("LONG" if position["long"] else "SHORT", *(position[k] for k in ("signal_ts", "entry_ts", "entry", "stop", "target", "quantity")), balance))
    return trades


ORDER = (
    "signal_ts timestamp_ntz, end_ts timestamp_ntz, direction string, trigger double, status string, stop double, reason string, fill_price double, "
    "created_bar long, expiry_bar long, setup string"
)
OPEN = "direction string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, entry double, stop double, target double, quantity double, balance double"
STATE = (
    "ts timestamp_ntz, bar long, balance double, slot string, signal string, accepted boolean, opened boolean, closed boolean, expired boolean, "
    "cancelled boolean, issue string, position string, entry double, stop double, target double, quantity double, bars_held long, "
    "waiting string, trigger double, waiting_stop double, expiry_bar long"
)
OUTPUTS = {"trades": TRADE, "orders": ORDER, "open": OPEN, "states": STATE}


def runs(bars: DataFrame, keys: list[str], step: int, settings: Settings = Settings(), machine=None, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """All outputs of one fold over every series: rows of several kinds (``kind``), each with the struct of its own kind.
    Store it and take ``part`` of it for each output that is wanted; nothing is folded twice.

    ``keys`` name series, segment and configuration; ``step`` is the width of the bars in seconds. Without a machine, ``bars``
    has ts, open, high, low, close, direction, stop, trigger and expiry, and maybe spread, target and setup. ``machine``
    is a function of no arguments that makes a new decision maker for each group: an object with ``decide`` and ``closed``,
    which sees all columns of ``bars``."""
    own = [*keys, "ts", "open", "high", "low", "close", "direction", "stop", "trigger", "expiry"]
    wanted = bars.columns if machine else [*own, *[c for c in ("spread", "target", "setup") if c in bars.columns and c not in keys]]
    numbers = {"open", "high", "low", "close", "stop", "trigger", "expiry", "spread", "target"} - set(keys)
    kept = bars.select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in wanted])
    kinds = {name: T.StructType.fromDDL(OUTPUTS[name]) for name in outputs}
    schema = T.StructType([*[kept.schema[k] for k in keys], T.StructField("kind", T.StringType()), *[T.StructField(n, k) for n, k in kinds.items()]])
    arrow = to_arrow_schema(schema)

    def folded(key: tuple, rows: Iterator) -> pa.Table:
        maker = machine() if machine else None
        found: dict[str, list] = {n: [] for n in OUTPUTS}
        asked = {n: found[n] if n in outputs else None for n in OUTPUTS}
        found["trades"] = fold(rows, settings, maker.decide if maker else by_columns, maker.closed if maker else None, asked["orders"], asked["open"], asked["states"])
        total, before, columns = sum(len(found[n]) for n in outputs), 0, {}
        for name in outputs:
            names = kinds[name].names
            own = [dict(zip(names, row, strict=True)) for row in found[name]]
            columns[name] = pa.array([None] * before + own + [None] * (total - before - len(own)), arrow.field(name).type)
            before += len(own)
        columns |= {"kind": pa.array([n for n in outputs for _ in found[n]], pa.string())}
        columns |= {k: pa.array([v] * total, arrow.field(k).type) for k, v in zip(keys, key, strict=True)}
        return pa.table([columns[f.name] for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folds series after series as their bars come in, without a list of bars."""

        def bars_in() -> Iterator[tuple]:
            for batch in batches:
                marks = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True)
                yield from zip(marks, batch.to_pandas().itertuples(index=False), strict=True)

        for key, rows in groupby(bars_in(), itemgetter(0)):
            own = (bar for _, bar in rows)
            yield from folded(key, own).to_batches()
            for _ in own:  # bars that the fold left, past its window
                pass

    found = kept.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInArrow(run, schema)
    return found.withColumn("_step", F.make_dt_interval(secs=F.lit(step))).withColumns({
        n: F.when(F.col(n).isNotNull(), F.col(n).withField("signal_ts", F.col(f"{n}.signal_ts") + F.col("_step"))) for n in outputs if n != "states"
    }).drop("_step")


def part(found: DataFrame, keys: list[str], output: str) -> DataFrame:
    """One output of ``runs``."""
    return found.filter(F.col("kind") == output).select(*keys, f"{output}.*")


def simulate(bars: DataFrame, keys: list[str], step: int, settings: Settings = Settings(), machine=None, output: str = "trades") -> DataFrame:
    """Trades (or ``output="orders"``: ended orders, ``"open"``: positions left open, ``"states"``: a row for each bar) of every
    series; see ``runs``, which gives several at once."""
    return part(runs(bars, keys, step, settings, machine, (output,)), keys, output)


def order_events(orders: DataFrame, step: int) -> DataFrame:
    """The lifecycle of pending orders, a row for each: when it was made and would expire, how it ended, and its fill."""
    rows = orders.filter("trigger is not null")
    filled = F.col("status") == "triggered"
    expiry = F.col("signal_ts") + F.make_dt_interval(secs=(F.col("expiry_bar") - F.col("created_bar") - 1) * step)
    own = [c for c in rows.columns if c not in {"end_ts", "reason", "fill_price", "created_bar"}]
    return rows.select(*own, F.col("signal_ts").alias("created_ts"), expiry.alias("expiry_ts"), F.col("reason").alias("cancel_reason"), F.when(filled, F.col("end_ts")).alias("fill_ts"), "fill_price")


def enriched(trades: DataFrame, bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Trades with what the bars show while they were open: best and worst price, when, in money per unit, R of the stop's
    distance and percent; the whole range; how much of it the exit kept; minutes; times of the pending order. Bars cannot
    show a path inside them, and count whole from entry to exit."""
    spans = trades.select(*keys, "trade_id", "direction", "entry_ts", "exit_ts")
    seen = contained(spans, bars.select(*keys, "ts", F.col("high").cast("double"), F.col("low").cast("double")), keys, "entry_ts", "exit_ts")
    early, long = -F.unix_micros(F.col("ts").cast("timestamp")), F.col("direction") == "LONG"
    up, down = F.struct("high", early.alias("e"), "ts"), F.struct((-F.col("low")).alias("_neg"), early.alias("e"), "ts")
    found = seen.groupBy(*keys, "trade_id").agg(F.max(up).alias("_u"), F.max(down).alias("_d"))
    rows = trades.join(found, [*keys, "trade_id"], "left")
    high, low = F.col("_u.high"), -F.col("_d._neg")
    distance, sign = F.abs(F.col("entry") - F.col("stop")), F.when(long, 1).otherwise(-1)
    price = {"mfe": F.when(long, high).otherwise(low), "mae": F.when(long, low).otherwise(high)}
    at = {"mfe": F.when(long, F.col("_u.ts")).otherwise(F.col("_d.ts")), "mae": F.when(long, F.col("_d.ts")).otherwise(F.col("_u.ts"))}
    kept = {"mfe": F.greatest(sign * (F.col("exit") - F.col("entry")), F.lit(0.0)), "mae": F.greatest(sign * (F.col("entry") - F.col("exit")), F.lit(0.0))}
    fields: dict[str, Column] = {}
    for n, name in (("mfe", "capture_efficiency"), ("mae", "adverse_efficiency")):
        amount = F.abs(price[n] - F.col("entry"))
        fields |= {f"{n}_price": price[n], f"{n}_amount": amount, f"{n}_r": F.when(distance > 0, amount / distance), f"{n}_percent": amount / F.abs(F.col("entry")) * 100}
        fields |= {f"{n}_ts": at[n], name: F.when(amount > 0, kept[n] / amount)}
    pending = F.col("trigger").isNotNull()
    bars_to = lambda n: F.make_dt_interval(secs=n * step)
    fields |= {
        "highest": high, "lowest": low, "minutes": (F.unix_seconds(F.col("exit_ts").cast("timestamp")) - F.unix_seconds(F.col("entry_ts").cast("timestamp"))) / 60,
        "stop_distance": distance, "entry_model": F.when(pending, "STOP_ENTRY_PENDING").otherwise("NEXT_OPEN"), "created_ts": F.when(pending, F.col("signal_ts")),
        "expiry_ts": F.when(pending, F.col("signal_ts") + bars_to(F.col("expiry_bar") - F.col("created_bar") - 1)),
        "excursion_model": F.when(high.isNotNull(), "BAR_BASED_APPROXIMATION"),
    }
    return rows.withColumns(fields).drop("_u", "_d")


def rule_counters(states: DataFrame, keys: list[str]) -> DataFrame:
    """How many bars gave a signal, how many signals were taken, what became of the others, and how many positions and
    orders ended: counts that add up, by series."""
    given = F.col("signal").isNotNull()
    flags = {"signals": given, "accepted": F.col("accepted"), "ignored": given & ~F.col("accepted"), **{n: F.col(n) for n in ("opened", "closed", "expired", "cancelled")}}
    reasons = {"while_open": "a position is open", "while_waiting": "an order is waiting", "before_window": "before the trade window"}
    flags |= {n: given & F.coalesce(F.col("issue") == text, F.lit(False)) for n, text in reasons.items()}
    flags["refused"] = given & F.coalesce(F.col("issue").startswith("refused: "), F.lit(False))
    return states.groupBy(*keys).agg(F.count("*").alias("bars"), *[F.count(F.when(c, 1)).alias(n) for n, c in flags.items()])


def spread_grid(bars: DataFrame, spreads: list[float]) -> DataFrame:
    """Bars for each of a few spreads (column ``spread``), to be simulated as bids, with keys that hold ``spread``."""
    return bars.withColumn("spread", F.explode(F.array(*[F.lit(float(x)) for x in spreads])))
