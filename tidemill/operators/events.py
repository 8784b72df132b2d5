"""Structural events of bars, as labels; pairing of entries and exits; broker fills against what was asked for.

Events depend on a bounded number of bars before, so numbered bars are dealt to blocks that overlap by that many, and a long
series is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import body_share, div
from tidemill.operators.carry import chunked, numbered, running, with_overlap

#: Labels by rule, for the upper and the lower side.
BREAK = ("BREAKOUT_UP", "BREAKDOWN")
FAILED = ("FAILED_BREAKOUT_REVERSAL_DOWN", "FAILED_BREAKDOWN_REVERSAL_UP")
RETEST = ("RETEST_AFTER_BREAKOUT_UP", "RETEST_AFTER_BREAKDOWN")
RECLAIM = ("RECLAIM_CONTINUATION_UP", "RECLAIM_CONTINUATION_DOWN")
SWEEP = ("SWEEP_REJECTION_UP", "SWEEP_REJECTION_DOWN")
CROSS = ("EMA20_CROSS_UP", "EMA20_CROSS_DOWN")
TOUCH_FAST = ("PULLBACK_TOUCH_EMA20_LONG", "PULLBACK_TOUCH_EMA20_SHORT")
TOUCH_SLOW = ("PULLBACK_TOUCH_EMA50_LONG", "PULLBACK_TOUCH_EMA50_SHORT")
STRONG = ("STRONG_CANDLE_UP", "STRONG_CANDLE_DOWN")


def bar_events(
    bars: DataFrame, keys: list[str], ts: str = "ts", structure: int = 20, sweep: int = 8, window: int = 5, tolerance: float = 0.1, body: float = 0.7, sizes: tuple[float, float] = (0.6, 2.0)
) -> DataFrame:
    """Adds ``events``, the labels of each bar, judged at its close. Bars carry ``fast`` and ``slow`` means and ``atr``; without
    a usable ``atr`` (null or 0) there are no retests, reclaims and strong candles. A break of the ``structure`` bars before
    is retested, then reclaimed, within ``window`` + 1 bars, each once, unless another break comes in between."""
    rows = with_overlap(numbered(bars, keys, [ts], "_n"), "_n", structure + window + 3)
    at = Window.partitionBy(*keys, "_block").orderBy("_n")
    past = lambda n: at.rowsBetween(-n, -1)
    enough = lambda n, c: F.when(F.count("*").over(past(n)) == n, c)
    stack = F.signum(F.col("fast") - F.col("slow"))
    rows = rows.withColumns({
        "_h": enough(structure, F.max("high").over(past(structure))), "_l": enough(structure, F.min("low").over(past(structure))),
        "_sh": enough(sweep, F.max("high").over(past(sweep))), "_sl": enough(sweep, F.min("low").over(past(sweep))), "_stack": stack, "_old": F.lag(stack).over(at),
    })
    o, h, lo, c, atr = (F.col(x) for x in ("open", "high", "low", "close", "atr"))
    usable = F.col("atr") > 0
    found: list[Column] = []
    for up, level, edge, swept, probe in ((True, "_h", lo, "_sh", h), (False, "_l", h, "_sl", lo)):
        beyond = (lambda a, b: a > b) if up else (lambda a, b: a < b)
        side = 0 if up else 1
        broke, mark = F.coalesce(beyond(c, F.col(level)), F.lit(False)), f"_broke{side}"
        rows = rows.withColumn(mark, broke)
        before = at.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({
            f"_was{side}": F.lag(F.when(F.col(mark), F.col(level))).over(at), f"_from{side}": F.max(F.when(F.col(mark), F.col("_n"))).over(before),
            f"_level{side}": F.last(F.when(F.col(mark), F.col(level)), ignorenulls=True).over(before),
        })
        alive = usable & (F.col("_n") - F.col(f"_from{side}") <= window + 1)
        near = edge <= F.col(f"_level{side}") + tolerance * atr if up else edge >= F.col(f"_level{side}") - tolerance * atr
        group = Window.partitionBy(*keys, "_block", f"_from{side}")
        rows = rows.withColumn(f"_test{side}", F.min(F.when(alive & near, F.col("_n"))).over(group))
        again = alive & (F.col("_n") > F.col(f"_test{side}")) & beyond(c, o) & beyond(c, F.col(f"_level{side}"))
        rows = rows.withColumn(f"_back{side}", F.min(F.when(again, F.col("_n"))).over(group))
        found += [
            F.when(beyond(F.col(f"_was{side}"), c), FAILED[side]), F.when(F.col(mark), BREAK[side]), F.when(F.col("_n") == F.col(f"_test{side}"), RETEST[side]),
            F.when(F.col("_n") == F.col(f"_back{side}"), RECLAIM[side]), F.when(beyond(probe, F.col(swept)) & beyond(F.col(swept), c), SWEEP[side]),
        ]
    rising, falling = F.col("_stack") > 0, F.col("_stack") < 0
    strong = usable & (body_share() >= body) & div(h - lo, atr).between(*sizes)
    found += [
        F.when((F.col("_old") <= 0) & rising, CROSS[0]), F.when((F.col("_old") >= 0) & falling, CROSS[1]),
        F.when(rising & (lo <= F.col("fast")), TOUCH_FAST[0]), F.when(falling & (h >= F.col("fast")), TOUCH_FAST[1]),
        F.when(rising & (lo <= F.col("slow")), TOUCH_SLOW[0]), F.when(falling & (h >= F.col("slow")), TOUCH_SLOW[1]),
        F.when(strong, F.when(c > o, STRONG[0]).otherwise(STRONG[1])),
    ]
    return rows.filter("_own").select(*bars.columns, F.array_compact(F.array(*found)).alias("events"))


def whole_trades(log: DataFrame, keys: list[str], order: list[str], entry: list[str], leave: list[str]) -> DataFrame:
    """Entries of a log of bars with the exit that closes each: the first one at or after it, before the next entry. Entries
    that never close have no exit; further exits, and those before the first entry (trade 0), count as ``unmatched_exits``.
    The first column of ``entry`` and ``leave`` is null where a bar has none."""
    opens, closes = F.col(entry[0]).isNotNull(), F.col(leave[0]).isNotNull()
    rows = running(chunked(log, keys, order), keys, order, sums={"trade": opens.cast("long")})
    found = rows.filter(opens | closes).groupBy(*keys, "trade").agg(
        F.max(F.when(opens, F.struct(*entry))).alias("_in"), F.min_by(F.when(closes, F.struct(*leave)), F.when(closes, F.struct(*order))).alias("_out"), F.count(F.when(closes, 1)).alias("_n"),
    )
    own = F.col("trade") > 0
    return found.select(
        *keys, "trade", *[F.col(f"_in.{c}").alias(c) for c in entry], *[F.when(own, F.col(f"_out.{c}")).alias(c) for c in leave],
        (F.col("_n") - F.when(own & (F.col("_n") > 0), 1).otherwise(0)).alias("unmatched_exits"),
    )


def fills(executions: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Submitted orders: slippage of the fill, how far the broker's stop and target lie from those asked for, partial fills."""
    gap = lambda a, b: F.col(a) - F.col(b)
    near = lambda a, b: F.coalesce(F.abs(gap(a, b)) <= tolerance, F.lit(False))
    return executions.filter("action = 'SUBMIT'").withColumns({
        "entry_slippage": gap("filled_price", "requested_price"), "sl_delta": gap("broker_sl", "requested_sl"), "tp_delta": gap("broker_tp", "requested_tp"),
        "partial_fill": F.coalesce((F.col("filled_volume") > 0) & (F.col("filled_volume") < F.col("requested_volume")), F.lit(False)),
        "sl_placed_correctly": near("broker_sl", "requested_sl"), "tp_placed_correctly": near("broker_tp", "requested_tp"),
    })


def fill_summary(executions: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: submissions, tags used more than once, partial fills, misplaced stops and targets, slippage, costs. Of equally
    large slippages the higher one is the worst."""
    slip = F.col("entry_slippage")
    found = fills(executions, tolerance).agg(
        F.count("*").alias("submissions"), F.count(F.when(F.col("partial_fill"), 1)).alias("partial_fills"),
        F.count(F.when(F.col("sl_delta").isNotNull() & ~F.col("sl_placed_correctly"), 1)).alias("sl_mismatches"),
        F.count(F.when(F.col("tp_delta").isNotNull() & ~F.col("tp_placed_correctly"), 1)).alias("tp_mismatches"),
        F.count(slip).alias("slippages"), F.avg(slip).alias("slippage_mean"), F.max(F.when(slip.isNotNull(), F.struct(F.abs(slip), slip.alias("v"))))["v"].alias("slippage_worst"),
        F.coalesce(F.sum("commission"), F.lit(0.0)).alias("commission_total"), F.coalesce(F.sum("swap"), F.lit(0.0)).alias("swap_total"),
    )
    tags = executions.groupBy("client_tag").agg(F.count("*").alias("n"), F.max((F.col("action") == "SUBMIT").cast("int")).alias("s")).filter("n > 1 and s = 1")
    # Both sides are one row.
    both = found.withColumn("_k", F.lit(0)).join(tags.agg(F.count("*").alias("duplicate_tags")).withColumn("_k", F.lit(0)), "_k").drop("_k")
    return both.withColumn("clean", (F.col("duplicate_tags") == 0) & (F.col("sl_mismatches") == 0) & (F.col("tp_mismatches") == 0))


def contribution(base: DataFrame, variant: DataFrame, keys: list[str], period: Column, name: str, value: str = "r") -> DataFrame:
    """By period (an expression on the keys): trades the variant adds and displaces, their results, and the net change, which
    includes changed results of common trades. Keys are unique on each side and not null."""
    a = base.select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias("_a"))
    b = variant.select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias("_b"))
    both = a.join(b, keys, "full").withColumn(name, period)
    added, gone = F.col("_a").isNull(), F.col("_b").isNull()
    some = lambda test, v: F.coalesce(F.sum(F.when(test, F.col(v))), F.lit(0.0))
    return both.groupBy(name).agg(
        F.count(F.when(added, 1)).alias("added"), some(added, "_b").alias("added_r"), F.count(F.when(gone, 1)).alias("displaced"), some(gone, "_a").alias("displaced_r"),
        (F.coalesce(F.sum("_b"), F.lit(0.0)) - F.coalesce(F.sum("_a"), F.lit(0.0))).alias("net_r"),
    )


def envelope(paths: DataFrame, sim: str, order: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles over paths of the cumulative result at each position. Paths are few (a parameter of the resampling) and
    positions many: one list of paths for each position."""
    rows = running(chunked(paths, [sim], [order]), [sim], [order], sums={"_sum": F.col(value)})
    rows = numbered(rows.drop("_chunk"), [sim], [order], "position")
    return rows.groupBy("position").agg(F.count("*").alias("paths"), *[F.percentile("_sum", q).alias(n) for n, q in shares.items()])
