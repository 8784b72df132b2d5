"""Expressions on broker contracts, quotes and orders. All are Spark columns; nulls give null unless noted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.candles import div, floor_to_step


@dataclass(frozen=True)
class Contract:
    """What a broker states about an instrument."""

    tick_size: float
    tick_value: float
    minimum_volume: float
    volume_step: float
    maximum_volume: float
    point: float
    stops_level: int = 0

    def digits(self) -> int:
        import math

        return max(0, round(-math.log10(self.point)))


def normalised_price(price: Column, contract: Contract) -> Column:
    """Price rounded to the digits of a point (ties of the printed number go to even); null unless finite and positive."""
    return F.when((price > 0) & (price < float("inf")), F.bround(price, contract.digits()))


def stop_fault(entry: Column, stop: Column, direction: Column, contract: Contract) -> Column:
    """Why a stop is refused, null where it is good: nearer than the stops level, or on the wrong side."""
    near = F.abs(entry - stop) < contract.stops_level * contract.point
    wrong = F.when(direction == "LONG", stop >= entry).otherwise(stop <= entry)
    return F.when(near, "too near").when(wrong, "wrong side")


def loss_per_lot(entry: Column, stop: Column, direction: Column, contract: Contract, spread: Column, commission: float = 0.0) -> Column:
    """Money lost at the stop with one lot, spread and commission included; null where the stop or a cost is refused."""
    lost = (F.abs(entry - stop) + spread) / contract.tick_size * contract.tick_value + commission
    return F.when(stop_fault(entry, stop, direction, contract).isNull() & (spread >= 0) & F.lit(commission >= 0), lost)


def pnl_from_prices(entry: Column, exit_: Column, direction: Column, lots: Column, contract: Contract) -> Column:
    """Result in money by ticks; null unless lots are positive."""
    move = F.when(direction == "LONG", exit_ - entry).otherwise(entry - exit_)
    return F.when(lots > 0, move / contract.tick_size * contract.tick_value * lots)


def margin_required(lots: Column, margin_per_lot: Column) -> Column:
    return F.when((lots > 0) & (margin_per_lot > 0), lots * margin_per_lot)


def rounded_volume(volume: Column, contract: Contract) -> Column:
    """Volume rounded down to whole steps; 0 below the smallest volume, at most the largest."""
    steps = floor_to_step(volume, contract.volume_step)
    return F.when(steps < contract.minimum_volume, 0.0).otherwise(F.least(steps, F.lit(contract.maximum_volume)))


def lot_size(
    equity: Column, risk_percent: float, entry: Column, stop: Column, direction: Column, contract: Contract, spread: Column, commission: float = 0.0,
    margin_per_lot: float | None = None,
) -> Column:
    """Lots whose loss at the stop is the risk budget, capped by margin; null where no volume is allowed."""
    raw = div(equity * risk_percent / 100, loss_per_lot(entry, stop, direction, contract, spread, commission))
    if margin_per_lot is not None:
        raw = F.least(raw, equity / margin_per_lot)
    lots = rounded_volume(raw, contract)
    return F.when((equity * risk_percent > 0) & (lots > 0), lots)


def quote_exit(direction: Column, stop: Column, target: Column, stop_first: bool = True) -> Column:
    """Exit in one quote bar: longs leave on the bid, shorts on the ask. A struct of ``price`` and ``reason``, or null."""
    long = direction == "LONG"
    hit_stop = F.when(long, F.col("bid_low") <= stop).otherwise(F.col("ask_high") >= stop)
    hit_target = F.when(long, F.col("bid_high") >= target).otherwise(F.col("ask_low") <= target)
    at_stop, at_target = (F.struct(p.alias("price"), F.lit(r).alias("reason")) for p, r in ((stop, "stop"), (target, "target")))
    return F.when(hit_stop, at_stop).when(hit_target, at_target) if stop_first else F.when(hit_target, at_target).when(hit_stop, at_stop)


def quote_side(direction: Column, event: Column) -> Column:
    """Side of the quote that an event trades on; null for unknown events."""
    buys = F.when(event.isin("entry", "pending_trigger"), direction == "LONG").when(event.isin("close", "stop_target"), direction == "SHORT")
    return F.when(buys, "ask").when(~buys, "bid")


def quote_price(bid: Column, ask: Column, direction: Column, event: Column) -> Column:
    """Price on the side an event trades on; null for a crossed or non-positive quote."""
    side = F.when(quote_side(direction, event) == "ask", ask).when(quote_side(direction, event) == "bid", bid)
    return F.when((bid > 0) & (ask >= bid), side)


def timeframe_label(minutes: Column) -> Column:
    """Minutes in words; two decimals unless within 0.01 of a whole number, and Unknown for null."""
    whole = F.abs(minutes - F.bround(minutes, 0)) < 0.01
    text = F.when(whole, F.bround(minutes, 0).cast("long").cast("string")).otherwise(F.format_string("%.2f", minutes.cast("double")))
    return F.when(minutes.isNull(), "Unknown").otherwise(F.concat(text, F.lit(" Minutes")))


def recovered_quantity(net: Column, entry: Column, exit_: Column, direction: Column, commission_percent: float) -> Column:
    """Quantity that gives a net result, when both sides pay a commission on their price."""
    move = F.when(direction == "LONG", exit_ - entry).otherwise(entry - exit_)
    return div(net, move - commission_percent / 100 * (entry + exit_))


def pullback_depth(extreme: Column, level: Column, atr: Column) -> Column:
    """Distance from an extreme to a level in units of the average range."""
    return F.when(atr > 0, F.abs(extreme - level) / atr)


def order_class(a_status: Column, b_status: Column, a_time: Column, b_time: Column, a_price: Column, b_price: Column, tolerance: float) -> Column:
    """How the order of a second feed compares with the first one's; a missing order has a null status."""
    first, second = (F.coalesce(s == "triggered", F.lit(False)) for s in (a_status, b_status))
    both = F.when(a_time != b_time, "TIMING_CHANGED_FILL").when(F.abs(a_price - b_price) > tolerance, "PRICE_CHANGED_FILL").otherwise("SAME_FILL")
    same = a_status.eqNullSafe(b_status)
    return (
        F.when(second & ~first, "SYNTHETIC_ONLY_FILL").when(first & ~second, "ORIGINAL_ONLY_FILL").when(first, both)
        .when(same & (a_status == "expired"), "EXPIRED_BOTH").when(same & (a_status == "cancelled"), "CANCELED_BOTH").otherwise("OTHER_ORDER_STATE")
    )


def replay_class(status: Column, touched: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How a trade replayed on finer data compares with the baseline. ``a`` and ``b`` hold entry_price, entry_time, pnl,
    exit_price, exit_reason, exit_time, entry_commission and exit_commission; the first difference that applies counts."""

    def differ(*names: str) -> Column:
        found = F.lit(False)
        for n in names:
            found |= ~a[n].eqNullSafe(b[n])
        return found

    level = F.when(F.contains(a["exit_reason"], F.lit("Stop loss")), "stop").when(F.contains(a["exit_reason"], F.lit("Take profit")), "target")
    open_ = status.isin("STILL_AMBIGUOUS", "REPLAY_DATA_MISSING", "REPLAY_DATA_INCOMPLETE", "FALLBACK_BASELINE_POLICY")
    return (
        F.when(open_, "STILL_AMBIGUOUS").when(status == "NOT_AMBIGUOUS", "IDENTICAL").when(differ("entry_price", "entry_time"), "ENTRY_CHANGED")
        .when((a["pnl"] > 0) != (b["pnl"] > 0), "OUTCOME_CHANGED").when(touched == level, "BASELINE_AMBIGUITY_RESOLVED")
        .when(differ("exit_price", "exit_reason"), "EXIT_CHANGED").when(differ("exit_time"), "TIMING_CHANGED")
        .when(differ("entry_commission", "exit_commission"), "COST_CHANGED").otherwise("IDENTICAL")
    )


def fill_bar(signal_ts: Column, entry_ts: Column, step: int) -> Column:
    """Bar after the signal on which a pending order filled: B+1, B+2, else null (such a fill is refused)."""
    late = F.unix_seconds(entry_ts.cast("timestamp")) - F.unix_seconds(signal_ts.cast("timestamp"))
    return F.when(late == 0, "B+1").when(late == step, "B+2")


def gap_fill(direction: Column, entry_open: Column, trigger: Column) -> Column:
    return F.when(F.when(direction == "LONG", entry_open > trigger).otherwise(entry_open < trigger), "Gap-through-trigger").otherwise("Normal")
