"""Replay of ambiguous bars: which level finer quotes reach first, and what that changes in a backtest's trades.

A bar of prices cannot tell whether a stop or a target came first, nor whether a stop was touched before or after a pending
entry. ``ambiguities`` finds such bars. Quotes of just those bars (an interval join by chunks of time) settle them: true ticks
by time and sequence, else the bars of a lower time frame, of which each gives its low and its high at one time, in no order.
What neither settles is left to the policy of the backtest. The trades of the backtest are never changed: comparisons and
scenarios are tables beside them.

Every step is a join on the ambiguity or an aggregate by it, so nothing depends on how many quotes a bar has. Rows without a
time, a side or a level that a step needs are left out of that step; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.candles import div
from tidemill.operators.carry import running
from tidemill.operators.joins import contained
from tidemill.operators.segments import seconds, with_previous
from tidemill.operators.stored import stored
from tidemill.sources.stores import fingerprint

BOTH_LEVELS, PENDING_ENTRY = "SL_AND_TP_SAME_CANDLE", "PENDING_ENTRY_AND_STOP_SAME_CANDLE"
TICK, LOWER, BASE = "TICK", "LOWER_TIMEFRAME", "BASE_BAR"
#: Data that were set apart: they may be replayed, but not tuned on.
RESERVED = ("FORWARD_VALIDATION", "HOLDOUT")


class ReplayBlocked(ValueError):
    """A replay that must not go on."""


# --- quotes


def tick_quotes(rows: DataFrame, keys: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """True quotes (ts, seq, bid, ask) by series. Blocks rows without time, bid or ask, and times that fall as the sequence
    goes on; nothing is filled in."""
    named = rows.select(*keys, F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    order = named.withColumns({"_chunk": F.struct(*keys, F.floor(F.col("seq") / 65536).alias("_at")), "_s": F.unix_micros(F.col("ts").cast("timestamp"))})
    before = running(order, keys, ["seq"], maxima={"_m": F.col("_s")}, before=True)
    missing = F.col("ts").isNull() | F.col("bid").isNull() | F.col("ask").isNull()
    found = before.agg(F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(F.col("_s") < F.col("_m"), 1)).alias("falling")).first()
    if found["missing"]:
        raise ReplayBlocked(f"{found['missing']} malformed quotes: time, bid or ask is missing")
    if found["falling"]:
        raise ReplayBlocked(f"{found['falling']} quotes are not in chronological order")
    return named


def lower_quotes(bars: DataFrame, keys: list[str], spread: float | str) -> DataFrame:
    """Two quotes of each bar of a lower time frame: its low and its high as bids, with a constant spread or that of a
    column. They share the bar's time."""
    more = F.col(spread) if isinstance(spread, str) else F.lit(float(spread))
    sides = F.posexplode(F.array(F.col("low").cast("double"), F.col("high").cast("double"))).alias("seq", "bid")
    return bars.select(*keys, "ts", more.alias("_more"), sides).select(*keys, "ts", "seq", "bid", (F.col("bid") + F.col("_more")).alias("ask"))


# --- what is ambiguous


def order_id(signal_ts: str = "signal_ts", direction: str = "direction") -> Column:
    """A pending order's name: the time of its signal and its side."""
    return F.concat_ws("-", F.date_format(signal_ts, "yyyy-MM-dd'T'HH:mm:ss"), direction)


def _hit(low: str, high: str, level: str, above: Column) -> Column:
    return F.when(above, F.col(high) >= F.col(level)).otherwise(F.col(low) <= F.col(level))


def ambiguities(trades: DataFrame, orders: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Exit bars that touch stop and target, and the bars on which a pending order filled that touch its stop as well.
    Pending orders are ``orders`` rows with a trigger that were triggered; the trade of one is that which was entered with
    it. Added: ``ambiguity_id``, unique within the tables."""
    long = F.col("direction") == "LONG"
    held = bars.select(*keys, F.col("ts").alias("bar_ts"), "low", "high")
    left = trades.select(*keys, "trade_id", "direction", F.col("exit_ts").alias("bar_ts"), "stop", "target").join(held, [*keys, "bar_ts"])
    left = left.filter(_hit("low", "high", "stop", ~long) & _hit("low", "high", "target", long))
    own = [F.lit(BOTH_LEVELS).alias("kind"), "trade_id", F.lit(None).cast("string").alias("order_id"), "direction", "bar_ts", "stop", "target", F.lit(None).cast("double").alias("trigger")]
    exits = left.select(*keys, *own)
    filled = orders.filter("status = 'triggered' and trigger is not null").withColumns({"order_id": order_id(), "bar_ts": F.col("end_ts")})
    filled = filled.select(*keys, "order_id", "direction", "bar_ts", "stop", "trigger").join(held, [*keys, "bar_ts"])
    filled = filled.filter(_hit("low", "high", "trigger", long) & _hit("low", "high", "stop", ~long))
    entered = trades.groupBy(*keys, F.col("entry_ts").alias("bar_ts")).agg(F.min("trade_id").alias("trade_id"))
    filled = filled.join(entered, [*keys, "bar_ts"], "left").withColumn("target", F.lit(None).cast("double"))
    pending = filled.select(*keys, F.lit(PENDING_ENTRY).alias("kind"), "trade_id", "order_id", "direction", "bar_ts", "stop", "target", "trigger")
    name = F.concat_ws("|", "kind", *[F.col(k).cast("string") for k in keys], F.coalesce("order_id", F.col("trade_id").cast("string")))
    return exits.unionByName(pending).withColumn("ambiguity_id", name)


def with_span(found: DataFrame, bars: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Adds when each ambiguity's bar ends (``until``, not included): a bar's width later, or where the next bar begins. Only
    the bars that matter are looked at: the next one is the least within a width."""
    end = F.col("bar_ts") + F.make_dt_interval(secs=F.lit(width))
    spans = found.select(*keys, "ambiguity_id", "bar_ts", end.alias("_end"))
    later = contained(spans, bars.select(*keys, "ts"), keys, "bar_ts", "_end").filter("ts > bar_ts").groupBy("ambiguity_id").agg(F.min("ts").alias("_next"))
    return found.join(later, "ambiguity_id", "left").withColumn("until", F.least(end, "_next")).drop("_next")


# --- what was touched first


def _touched(level: str) -> Column:
    long = F.col("direction") == "LONG"
    if level == "trigger":
        return F.when(long, F.col("ask") >= F.col(level)).otherwise(F.col("bid") <= F.col(level))
    if level == "stop":
        return F.when(long, F.col("bid") <= F.col(level)).otherwise(F.col("ask") >= F.col(level))
    return F.when(long, F.col("bid") >= F.col(level)).otherwise(F.col("ask") <= F.col(level))


def touches(found: DataFrame, quotes: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    """For each ambiguity (with ``until``) that has quotes: the level that is touched first, the quote that did, whether two
    levels are touched at once (``tied``), and for pending entries the same of what follows the trigger. ``exact`` quotes
    are ordered by time and sequence; others of one time have no order."""
    span = found.select(*keys, "ambiguity_id", "kind", "direction", "stop", "target", "trigger", "bar_ts", (F.col("until") - F.expr("interval 1 microsecond")).alias("_last"))
    rows = contained(span, quotes.select(*keys, "ts", "seq", "bid", "ask"), keys, "bar_ts", "_last")
    at = F.struct("ts", "seq", "bid", "ask")
    pending = F.col("kind") == PENDING_ENTRY

    def earliest(level: str, when: Column) -> Column:
        return F.min(F.when(when & _touched(level), at)).alias(f"_{level}")

    def decided(a: Column, b: Column) -> tuple[Column, Column]:
        """(whether ``a`` comes before ``b``, whether both come at once)."""
        x, y = (F.struct(c["ts"], c["seq"]) if exact else F.struct(c["ts"]) for c in (a, b))
        return a.isNotNull() & (b.isNull() | (x < y)), a.isNotNull() & b.isNotNull() & (x == y)

    first = rows.groupBy("ambiguity_id").agg(
        F.count("*").alias("quotes"), earliest("trigger", pending), earliest("stop", ~pending), earliest("target", ~pending)
    )
    after = rows.filter(pending).join(first.select("ambiguity_id", F.col("_trigger").alias("_t")), "ambiguity_id")
    later = F.struct("ts", "seq") > F.struct("_t.ts", "_t.seq") if exact else F.col("ts") > F.col("_t.ts")
    after = after.filter(later).groupBy("ambiguity_id").agg(earliest("stop", F.lit(True)), earliest("target", F.lit(True)))
    after = after.select("ambiguity_id", F.col("_stop").alias("_stop2"), F.col("_target").alias("_target2"))
    stop, target, stop2, target2 = (F.col(c) for c in ("_stop", "_target", "_stop2", "_target2"))
    s, tied = decided(stop, target)
    t, _ = decided(target, stop)
    s2, tied2 = decided(stop2, target2)
    t2, _ = decided(target2, stop2)
    level = F.when(F.col("_trigger").isNotNull(), "trigger").when(s, "stop").when(t, "target")
    event = F.when(F.col("_trigger").isNotNull(), F.col("_trigger")).when(s, stop).when(t, target)
    second = F.when(s2, "stop").when(t2, "target")
    return first.join(after, "ambiguity_id", "left").select(
        "ambiguity_id", "quotes", level.alias("level"), event.alias("event"), tied.alias("tied"),
        second.alias("second_level"), F.when(s2, stop2).when(t2, target2)["ts"].alias("second_ts"), tied2.alias("second_tied"),
    )


def _answer(level: Column, second: Column, tied: Column) -> Column:
    """What a touched level means; for an entry, with what came after it."""
    later = F.when(second.isNotNull(), F.concat(F.lit("activated_then_"), second)).when(tied, "activated_then_ambiguous").otherwise("activated_only")
    return F.when(level == "trigger", later).otherwise(level)


def resolved(found: DataFrame, keys: list[str], ticks: DataFrame | None = None, lower: DataFrame | None = None, policy: str = "SL_FIRST") -> DataFrame:
    """Each ambiguity (with ``until``) with its ``status``: by ticks, else by the lower time frame, else by the policy. A series
    without any quotes is REPLAY_DATA_MISSING; where its quotes do not settle a bar, the policy's level counts
    (FALLBACK_BASELINE_POLICY), if the ambiguity has that level (else REPLAY_DATA_INCOMPLETE). Levels that are touched at
    once stay STILL_AMBIGUOUS."""
    rows = found
    for name, quotes, exact in (("tick", ticks, True), ("low", lower, False)):
        if quotes is None:
            rows = rows.withColumns({f"_{name}": F.lit(None).cast("struct<level: string>"), f"_has_{name}": F.lit(False)})
            continue
        own = touches(found, quotes, keys, exact)
        own = own.select("ambiguity_id", F.struct(*own.columns[1:]).alias(f"_{name}"))
        known = quotes.select(*keys).distinct().withColumn(f"_has_{name}", F.lit(True))
        rows = rows.join(own, "ambiguity_id", "left").join(known, keys, "left")
    left = F.lit("target" if policy == "TP_FIRST" else "stop")
    parts = {}
    for name, quotes in (("tick", ticks), ("low", lower)):
        t = F.col(f"_{name}")
        if quotes is None:
            none = F.lit(None).cast("string")
            parts[name] = {"use": F.lit(False), "unclear": F.lit(False), "level": none, "event": None, "second": none, "second_ts": F.lit(None).cast("timestamp_ntz"), "answer": none}
            continue
        pending = F.col("kind") == PENDING_ENTRY
        unclear = F.coalesce(F.when(pending, t["level"].isNotNull() & t["second_level"].isNull() & t["second_tied"]).otherwise(t["tied"]), F.lit(False))
        parts[name] = {
            "use": t["level"].isNotNull() | unclear, "unclear": unclear, "level": t["level"], "event": t["event"], "second": t["second_level"],
            "second_ts": t["second_ts"], "answer": F.when(t["level"].isNotNull(), _answer(t["level"], t["second_level"], t["second_tied"])),
        }
    tick, low = parts["tick"], parts["low"]
    covered = F.coalesce(F.col("_has_tick"), F.lit(False)) | F.coalesce(F.col("_has_low"), F.lit(False))
    has_level = F.when(left == "target", F.col("target").isNotNull()).otherwise(F.col("stop").isNotNull())
    fallback = ~tick["use"] & ~low["use"] & covered & has_level

    def best(name: str, otherwise: Column) -> Column:
        return F.when(tick["use"], tick[name]).when(low["use"], low[name]).otherwise(otherwise)

    def of_event(field: str, kind: str) -> Column:
        empty = F.lit(None).cast(kind)
        a, b = (p["event"][field] if p["event"] is not None else empty for p in (tick, low))
        return F.when(tick["use"], a).when(low["use"], b).otherwise(empty)

    status = (
        F.when(tick["use"], F.when(tick["unclear"], "STILL_AMBIGUOUS").otherwise("EXACT_TICK_RESOLUTION"))
        .when(low["use"], F.when(low["unclear"], "STILL_AMBIGUOUS").otherwise("LOWER_TF_RESOLUTION"))
        .when(~covered, "REPLAY_DATA_MISSING").when(has_level, "FALLBACK_BASELINE_POLICY").otherwise("REPLAY_DATA_INCOMPLETE")
    )
    level = best("level", F.when(fallback, left))
    side = F.when(level == "trigger", "ask").when(level.isNotNull(), "bid")
    bid, ask, long = of_event("bid", "double"), of_event("ask", "double"), F.col("direction") == "LONG"
    price = F.when(fallback, F.when(left == "target", F.col("target")).otherwise(F.col("stop"))).when(level == "trigger", F.when(long, ask).otherwise(bid)).otherwise(bid)
    at = of_event("ts", "timestamp_ntz")
    return rows.select(
        *found.columns, status.alias("status"), F.when(tick["use"], TICK).when(low["use"], LOWER).otherwise(BASE).alias("source"), level.alias("touched_level"),
        at.alias("event_ts"), side.alias("quote_side"), price.alias("resolved_price"), best("answer", F.when(fallback, left)).alias("outcome"),
        F.when(level == "trigger", at).alias("activation_ts"), best("second", F.lit(None).cast("string")).alias("second_level"),
        best("second_ts", F.lit(None).cast("timestamp_ntz")).alias("second_ts"),
    )


# --- what it changes


def compared(resolutions: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each resolution whose trade is known: the trade as it was, as it is with the resolved exit, and a class for
    the change. The result of a changed trade leaves costs as they were."""
    own = ["trade_id", "direction", "entry_ts", "entry", "stop", "exit_ts", "exit", "reason", "quantity", "pnl", "r", "risk", "entry_cost", "exit_cost"]
    r = resolutions.select(*keys, "trade_id", "ambiguity_id", "kind", "bar_ts", "status", "source", "touched_level", "event_ts", "resolved_price")
    rows = r.join(trades.select(*keys, *own), [*keys, "trade_id"])
    level = F.col("touched_level")
    moved = level.isin("stop", "target") & F.col("resolved_price").isNotNull()
    sign = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    distance = F.abs(F.col("entry") - F.col("stop"))
    risk = F.when(F.col("risk") != 0, F.col("risk")).when(distance != 0, distance).otherwise(1.0)
    gain = (F.col("resolved_price") - F.col("entry")) * sign
    replayed = {
        "replay_exit": F.when(moved, F.col("resolved_price")).otherwise(F.col("exit")),
        "replay_exit_ts": F.when(moved, F.coalesce("event_ts", "exit_ts")).otherwise(F.col("exit_ts")),
        "replay_reason": F.when(moved, F.concat(F.upper(level), F.lit(" ("), F.lower("source"), F.lit(" replay)"))).otherwise(F.col("reason")),
        "replay_pnl": F.when(moved, gain * F.col("quantity") - F.col("entry_cost") - F.col("exit_cost")).otherwise(F.col("pnl")),
        "replay_r": F.when(moved, gain / risk).otherwise(F.col("r")),
    }
    rows = rows.withColumns(replayed)
    before = F.when(F.col("reason").startswith("STOP"), "stop").when(F.col("reason").startswith("TARGET"), "target")
    label = (
        F.when(F.col("status").isin("STILL_AMBIGUOUS", "REPLAY_DATA_MISSING", "REPLAY_DATA_INCOMPLETE", "FALLBACK_BASELINE_POLICY"), "STILL_AMBIGUOUS")
        .when((F.col("pnl") > 0) != (F.col("replay_pnl") > 0), "OUTCOME_CHANGED").when(level == before, "BASELINE_AMBIGUITY_RESOLVED")
        .when((F.col("exit") != F.col("replay_exit")) | (F.col("reason") != F.col("replay_reason")), "EXIT_CHANGED")
        .when(F.col("exit_ts") != F.col("replay_exit_ts"), "TIMING_CHANGED").otherwise("IDENTICAL")
    )
    minutes = lambda end: (seconds(end) - seconds("entry_ts")) / 60
    return rows.withColumns({"minutes": minutes("exit_ts"), "replay_minutes": minutes("replay_exit_ts"), "change": label})


def scenario(trades: DataFrame, comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many trades change, and totals with the replayed trades less those without. Of several resolutions of one
    trade the pending entry's counts, then the latest. Drawdown is left out: it needs the whole path."""
    last = F.struct(F.col("kind") == PENDING_ENTRY, "bar_ts", "ambiguity_id")
    per_trade = comparisons.groupBy(*keys, "trade_id").agg(F.max_by(F.struct("replay_pnl", "replay_r"), last).alias("_new"))
    rows = trades.select(*keys, "trade_id", "pnl", "r").join(per_trade, [*keys, "trade_id"], "left")
    pnl, r = F.coalesce("_new.replay_pnl", "pnl"), F.coalesce("_new.replay_r", "r")
    gross = lambda c, up: F.sum(F.when(c > 0 if up else c < 0, F.abs(c)).otherwise(0.0))
    factor = lambda c: F.when(gross(c, False) > 0, gross(c, True) / gross(c, False))
    totals = rows.agg(
        F.coalesce(F.sum(pnl) - F.sum("pnl"), F.lit(0.0)).alias("pnl_difference"), F.coalesce(F.sum(r) - F.sum("r"), F.lit(0.0)).alias("r_difference"),
        (factor(pnl) - factor(F.col("pnl"))).alias("factor_difference"), (F.avg(r) - F.avg("r")).alias("mean_r_difference"),
    )
    changed = ~F.col("change").isin("IDENTICAL", "STILL_AMBIGUOUS")
    counts = comparisons.agg(
        F.count(F.when(changed, 1)).alias("changed_trades"), F.count(F.when(~changed, 1)).alias("unchanged_trades"),
        F.count(F.when((F.col("pnl") > 0) & (F.col("replay_pnl") <= 0), 1)).alias("winners_to_losers"),
        F.count(F.when((F.col("pnl") <= 0) & (F.col("replay_pnl") > 0), 1)).alias("losers_to_winners"),
    )
    return counts.crossJoin(totals)


def sensitivity(found: DataFrame, resolutions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row: ambiguities, how many were settled, and how much that changes."""
    settled = F.col("status").isin("EXACT_TICK_RESOLUTION", "LOWER_TF_RESOLUTION")
    a = found.agg(F.count("*").alias("ambiguous"))
    b = resolutions.agg(F.count("*").alias("replayed"), F.count(F.when(settled, 1)).alias("settled"), F.count(F.when(~settled & (F.col("status") != "NOT_AMBIGUOUS"), 1)).alias("still_ambiguous"))
    change = F.sum(F.coalesce("replay_r", F.lit(0.0)) - F.coalesce("r", F.lit(0.0)))
    c = comparisons.agg(F.count(F.when(F.col("change") == "OUTCOME_CHANGED", 1)).alias("outcome_changed"), F.coalesce(change, F.lit(0.0)).alias("r_change"))
    rows = a.crossJoin(b).crossJoin(c)
    return rows.withColumns({f"{n}_percent": div(F.col(n) * 100.0, F.col("replayed")) for n in ("settled", "outcome_changed")})


def coverage(trades: DataFrame, found: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """For each series of quotes or trades: their first and last time, and how many trades (by exit) and ambiguities (by
    bar) lie between."""
    ends = quotes.groupBy(*keys).agg(F.min("ts").alias("first_quote"), F.max("ts").alias("last_quote"))

    def split(rows: DataFrame, at: str, name: str) -> DataFrame:
        inside = F.coalesce(F.col(at).between(F.col("first_quote"), F.col("last_quote")), F.lit(False))
        return rows.join(ends, keys, "left").groupBy(*keys).agg(F.count(F.when(inside, 1)).alias(f"{name}_covered"), F.count(F.when(~inside, 1)).alias(f"{name}_outside"))

    every = trades.select(*keys).union(ends.select(*keys)).distinct()
    counted = every.join(ends, keys, "left").join(split(trades, "exit_ts", "trades"), keys, "left").join(split(found, "bar_ts", "ambiguities"), keys, "left")
    return counted.fillna(0, [f"{n}_{s}" for n in ("trades", "ambiguities") for s in ("covered", "outside")])


def forensic_trace(comparisons: DataFrame, trades: DataFrame, found: DataFrame, quotes: DataFrame, keys: list[str], source: str) -> DataFrame:
    """What happened to each compared trade, as rows in order: signal, order, the quotes of the ambiguous bar, the touched
    level, and the exit."""
    own = [*keys, "trade_id", "ambiguity_id"]
    none = {"bid": F.lit(None).cast("double"), "ask": F.lit(None).cast("double"), "level": F.lit(None).cast("string"), "seq": F.lit(None).cast("long")}

    def stage(rows: DataFrame, number: int, name: str | Column, ts: str, price: Column, **more: Column) -> DataFrame:
        fields = {"stage_no": F.lit(number), "stage": F.lit(name) if isinstance(name, str) else name, "ts": F.col(ts), "price": price, **none, **more}
        return rows.select(*own, *[c.alias(n) for n, c in fields.items()])

    signals = trades.select(*keys, "trade_id", "signal_ts")
    c = comparisons.join(signals, [*keys, "trade_id"])
    spans = found.select(*keys, "ambiguity_id", "bar_ts", (F.col("until") - F.expr("interval 1 microsecond")).alias("_last"))
    seen = contained(spans, quotes.select(*keys, "ts", "seq", "bid", "ask"), keys, "bar_ts", "_last").join(comparisons.select("ambiguity_id", "trade_id"), "ambiguity_id")
    empty = F.lit(None).cast("double")
    touched = F.when(F.col("touched_level") == "trigger", "entry_trigger").otherwise("sl_tp_state")
    parts = [
        stage(c, 1, "strategy_signal", "signal_ts", empty), stage(c, 2, "order_creation", "entry_ts", F.col("entry")),
        stage(seen, 3, "replay_event", "ts", empty, bid=F.col("bid"), ask=F.col("ask"), seq=F.col("seq").cast("long"), level=F.lit(source)),
        stage(c.filter("touched_level is not null"), 4, touched, "event_ts", F.col("resolved_price"), level=F.col("touched_level")),
        stage(c, 5, "final_resolution", "exit_ts", F.col("exit"), level=F.col("status")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def gap_class(before: Column, after: Column, width: int, first: Column, last: Column, session: Column) -> Column:
    """The kind of a gap between two bars, given when quotes begin and end and whether a session ends there."""
    gap = seconds(after) - seconds(before)
    known = first.isNotNull() & last.isNotNull()
    return (
        F.when(before.isNull() | after.isNull(), "MARKET_GAP").when(gap <= width, "NOT_A_GAP").when(session, "SESSION_GAP")
        .when(known & (before >= first) & (after <= last), "REPLAY_DATA_GAP").when(known, "MISSING_DATA_GAP").otherwise("MARKET_GAP")
    )


def gaps(bars: DataFrame, quotes: DataFrame | None, keys: list[str], width: int, session: Column | None = None) -> DataFrame:
    """Each gap of a series of bars with its kind."""
    rows = with_previous(bars.select(*keys, "ts"), keys).select(*keys, F.col("prev_ts").alias("before"), F.col("ts").alias("after"))
    rows = rows.filter(seconds("after") - seconds("before") > width)
    if quotes is None:
        none = F.lit(None).cast("timestamp_ntz")
        rows = rows.withColumns({"_first": none, "_last": none})
    else:
        rows = rows.join(quotes.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last")), keys, "left")
    kind = gap_class(F.col("before"), F.col("after"), width, F.col("_first"), F.col("_last"), F.lit(False) if session is None else session)
    return rows.withColumn("gap", kind).drop("_first", "_last")


# --- runs


def replay_fingerprint(baseline: str, quotes: str, resolution: str, quote_model: str, config: dict, version: str) -> str:
    """What identifies a replay: the backtest, the quotes, how they are used, and the version."""
    return fingerprint({"baseline": baseline, "quotes": quotes, "resolution": resolution, "quote_model": quote_model, "config": config, "version": version})


def resumable(stored: dict, baseline: str, quotes: str, config: dict) -> dict:
    """The stored run, if it was of this backtest, these quotes and this configuration; else the replay is blocked."""
    given = {"baseline": baseline, "quotes": quotes, "config": config}
    changed = [f"{n} changed" for n, v in given.items() if stored.get(n) != v]
    if changed:
        raise ReplayBlocked("resume blocked: " + "; ".join(changed))
    return stored


def reserved_warning(role: str) -> str | None:
    return "reserved data: do not tune on the results of this replay" if role in RESERVED else None


def replay(
    trades: DataFrame, orders: DataFrame, bars: DataFrame, keys: list[str], width: int, ticks: DataFrame | None = None, lower: DataFrame | None = None,
    policy: str = "SL_FIRST", selected: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Finds the ambiguous bars of a backtest and settles them: tables ``ambiguities``, ``resolutions``, ``comparisons``,
    ``scenario``, ``sensitivity`` and, with quotes, ``coverage``. ``selected`` (keys, trade_id) keeps only the ambiguities of
    those trades. What several tables need is stored once."""
    every = stored(ambiguities(trades, orders, bars, keys))
    found = every if selected is None else every.join(selected.select(*keys, "trade_id").distinct(), [*keys, "trade_id"], "left_semi")
    found = stored(with_span(found, bars, keys, width))
    resolutions = stored(resolved(found, keys, ticks, lower, policy))
    comparisons = compared(resolutions, trades, keys)
    tables = {"ambiguities": every, "resolutions": resolutions, "comparisons": comparisons}
    tables |= {"scenario": scenario(trades, comparisons, keys), "sensitivity": sensitivity(every, resolutions, comparisons)}
    quotes = ticks if ticks is not None else lower
    return tables if quotes is None else tables | {"coverage": coverage(trades, every, quotes, keys)}
