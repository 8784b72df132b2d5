"""What a new family of setups costs a system that has one slot: three backtests (the system alone, with the family, and the
family alone) and the orders of the second, compared trade by trade.

A trade is known by setup, direction and entry. ``lost`` are the system's trades that no longer happen, with who held the
slot; ``family`` are the family's trades by what they took away; ``suppressed`` are those of the family alone that never got
the slot, by what held it. Who holds the slot at a time is an interval join by chunks of time; of several the earliest counts.
All joins are by sorting: each side grows with the trades, and several broadcasts at once would fill the driver.
Trades without an entry or exit time are left out of who holds what; times at an interval's ends lie inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.candles import div
from tidemill.operators.joins import contained

#: Seconds of a chunk in interval joins: trades last from minutes to weeks.
CHUNK = 7 * 86_400


def occupants(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: list[str], at: str) -> DataFrame:
    """For each point inside an interval (entry_ts, exit_ts): the first such interval by entry, exit and id."""
    spans = intervals.filter("entry_ts <= exit_ts").select(*keys, "entry_ts", "exit_ts", F.col("setup").alias("_setup"), F.col("trade_id").alias("_id"))
    marks = points.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in point_id], F.col(at).alias("_at"))
    held = contained(spans, marks, keys, "entry_ts", "exit_ts", ts="_at", chunk=CHUNK)
    first = F.min(F.struct(F.col("entry_ts").alias("held_from"), F.col("exit_ts").alias("held_to"), F.col("_id").alias("held_id"), F.col("_setup").alias("held_by")))
    found = held.groupBy(*keys, *[f"_p_{c}" for c in point_id]).agg(first.alias("_o"))
    return found.select(*keys, *[F.col(f"_p_{c}").alias(c) for c in point_id], "_o.*")


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which null equals null."""
    right = b.select(*[F.col(c).alias(f"_r_{c}") for c in on]).distinct()
    test = F.lit(True)
    for c in on:
        test &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.join(right.hint("merge"), test, how)


def lost(baseline: DataFrame, combined: DataFrame, keys: list[str], family: str) -> DataFrame:
    """The system's trades that are gone, with ``class``: DISPLACED_SAME_BAR (the family entered on their bar),
    BLOCKED_WHILE_HOLDING (it held a position), or LOST_OTHERWISE."""
    gone = _same(baseline, combined, [*keys, "setup", "direction", "entry_ts"], "left_anti")
    held = occupants(gone, combined, keys, ["trade_id"], "entry_ts")
    rows = gone.join(held.hint("merge"), [*keys, "trade_id"], "left")
    theirs = F.coalesce(F.col("held_by") == family, F.lit(False))
    label = F.when(theirs & (F.col("held_from") == F.col("entry_ts")), "DISPLACED_SAME_BAR").when(theirs, "BLOCKED_WHILE_HOLDING").otherwise("LOST_OTHERWISE")
    return rows.withColumn("class", label).select(*baseline.columns, "held_by", "class")


def family_trades(baseline: DataFrame, combined: DataFrame, gone: DataFrame, keys: list[str], family: str) -> DataFrame:
    """The family's trades within the system, with ``class``: DISPLACED_A_TRADE (one of the system's was open, or entered, at
    its entry), BLOCKED_A_TRADE (it entered a free slot, and held it when one that is gone would have entered), or
    ADDITIVE; and whether it overlaps any trade of the system alone (``overlaps``)."""
    own = combined.filter(F.col("setup") == family)
    at_entry = occupants(own, baseline, keys, ["trade_id"], "entry_ts").select(*keys, "trade_id", F.lit(True).alias("_clash"))
    starts = baseline.select(*keys, "entry_ts").distinct().withColumn("_same", F.lit(True))
    taken = gone.filter("class in ('DISPLACED_SAME_BAR', 'BLOCKED_WHILE_HOLDING')").select(*keys, F.col("entry_ts").alias("_at"))
    later = contained(own.select(*keys, "trade_id", "entry_ts", "exit_ts"), taken, keys, "entry_ts", "exit_ts", ts="_at", chunk=CHUNK)
    later = later.filter("_at > entry_ts").select(*keys, "trade_id").distinct().withColumn("_later", F.lit(True))
    begun = contained(own.select(*keys, "trade_id", "entry_ts", "exit_ts"), baseline.select(*keys, F.col("entry_ts").alias("_at")), keys, "entry_ts", "exit_ts", ts="_at", chunk=CHUNK)
    begun = begun.select(*keys, "trade_id").distinct().withColumn("_begun", F.lit(True))
    rows = own.join(at_entry.hint("merge"), [*keys, "trade_id"], "left").join(starts.hint("merge"), [*keys, "entry_ts"], "left")
    rows = rows.join(later.hint("merge"), [*keys, "trade_id"], "left").join(begun.hint("merge"), [*keys, "trade_id"], "left")
    clash, same, after = (F.coalesce(c, F.lit(False)) for c in ("_clash", "_same", "_later"))
    label = F.when(clash & same, "DISPLACED_A_TRADE").when(after, "BLOCKED_A_TRADE").when(clash, "DISPLACED_A_TRADE").otherwise("ADDITIVE")
    overlaps = clash | F.coalesce("_begun", F.lit(False))
    return rows.withColumns({"class": label, "overlaps": overlaps}).select(*combined.columns, "class", "overlaps")


def suppressed(combined: DataFrame, standalone: DataFrame, orders: DataFrame, keys: list[str], family: str) -> DataFrame:
    """The trades of the family alone, with ``class``: REACHED (it entered there within the system too), HELD_POSITION or
    HELD_ORDER by what kept the slot. ``orders`` are those of the system with the family: created_ts, fill_ts or null,
    expiry_ts, setup. Where nothing is seen to hold the slot, an open position is taken to be the cause."""
    reached = combined.filter(F.col("setup") == family).select(*keys, "entry_ts").distinct().withColumn("_reached", F.lit(True))
    held = occupants(standalone, combined, keys, ["trade_id"], "entry_ts").select(*keys, "trade_id", "held_by")
    waits = orders.filter(~F.col("setup").eqNullSafe(family)).select(*keys, F.col("created_ts").alias("entry_ts"), F.coalesce("fill_ts", "expiry_ts").alias("exit_ts"), "setup", F.lit(0).alias("trade_id"))
    waiting = occupants(standalone, waits, keys, ["trade_id"], "entry_ts").select(*keys, "trade_id", F.lit(True).alias("_waits"))
    rows = standalone.join(reached.hint("merge"), [*keys, "entry_ts"], "left").join(held.hint("merge"), [*keys, "trade_id"], "left")
    rows = rows.join(waiting.hint("merge"), [*keys, "trade_id"], "left")
    position = F.col("held_by").isNotNull() & (F.col("held_by") != family)
    label = F.when(F.col("_reached"), "REACHED").when(position, "HELD_POSITION").when(F.col("_waits"), "HELD_ORDER").otherwise("HELD_POSITION")
    return rows.withColumn("class", label).select(*standalone.columns, "class")


def ledger(baseline: DataFrame, combined: DataFrame, standalone: DataFrame, orders: DataFrame, keys: list[str], family: str) -> DataFrame:
    """Trades, total and mean result of each class of the three parts, and of each setup in it."""
    gone = lost(baseline, combined, keys, family)
    parts = {"LOST": gone, "FAMILY": family_trades(baseline, combined, gone, keys, family), "SUPPRESSED": suppressed(combined, standalone, orders, keys, family)}
    rows = None
    for name, df in parts.items():
        own = df.groupBy("class", "setup").agg(F.count("*").alias("trades"), F.sum("r").alias("total_r")).withColumn("part", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.select("part", "class", "setup", "trades", "total_r", div(F.col("total_r"), F.col("trades")).alias("mean_r"))


def contribution(found: DataFrame) -> DataFrame:
    """One row from a ledger: what the family's additive trades bring less what the trades bring that it took the slot of, and
    the share of its trades that cost one."""
    family, gone = F.col("part") == "FAMILY", F.col("part") == "LOST"
    free, cost = family & (F.col("class") == "ADDITIVE"), gone & (F.col("class") != "LOST_OTHERWISE")
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    rows = found.agg(total(free, "total_r").alias("free_r"), total(cost, "total_r").alias("cost_r"), total(free, "trades").alias("free_trades"), total(family, "trades").alias("family_trades"))
    share = div((F.col("family_trades") - F.col("free_trades")) * 100.0, F.col("family_trades"))
    return rows.withColumns({"net_free_r": F.col("free_r") - F.col("cost_r"), "costly_percent": share})


def capacity(events: DataFrame, setups: DataFrame, fills: DataFrame, added: DataFrame, free: DataFrame, months: Column) -> DataFrame:
    """One row: how many events, setups, fills of the family alone, added trades and free trades there are, each also by
    month, and how many percent of each step go on to the next. ``months`` is the span in months, an expression of
    constants."""
    names = ["events", "setups", "fills", "added", "free"]
    rows = None
    for name, df in zip(names, (events, setups, fills, added, free), strict=True):
        own = df.agg(F.count("*").alias(name))
        rows = own if rows is None else rows.crossJoin(own)
    per_month = {f"{n}_per_month": F.round(F.col(n) / months, 2) for n in names}
    steps = {f"{a}_to_{b}_percent": F.round(div(F.col(b) * 100.0, F.col(a)), 2) for a, b in (("events", "setups"), ("setups", "fills"), ("fills", "free"))}
    return rows.withColumns({**per_month, **steps})
