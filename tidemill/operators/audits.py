"""Audits of candle tables and of append-only logs, and what follows from them: warm-up and usable segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import invalid_ohlcv
from tidemill.operators.segments import seconds, segments, with_previous


def candle_audit(bars: DataFrame, keys: list[str], step: int = 900, ts: str = "ts") -> DataFrame:
    """Counters of one series' faults, and whether it passes: one aggregation beside the counts of repeated times."""
    repeated = bars.groupBy(*keys, ts).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum((F.col("_n") > 1).cast("long")).alias("repeated_ts"))
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in ("open", "high", "low", "close", "volume")]
    found = bars.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *nulls, F.sum(invalid_ohlcv().cast("long")).alias("invalid"), F.sum((F.col("high") < F.col("low")).cast("long")).alias("inverted"),
        F.sum((F.col("high") == F.col("low")).cast("long")).alias("flat"), F.sum((F.col("volume") == 0).cast("long")).alias("no_volume"),
        F.sum((seconds(ts) % step != 0).cast("long")).alias("off_grid"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )
    joined = found.join(repeated, keys)
    return joined.withColumn("passed", (F.col("invalid") == 0) & (F.col("off_grid") == 0) & (F.col("repeated_ts") == 0))


def log_audit(log: DataFrame, keys: list[str], ordinal: str, step: int, ts: str = "ts") -> DataFrame:
    """Exactly-once check of a log in the order it was written: repeated times, steps back, gaps. Neighbours in the log
    are found within runs of 100,000 ordinals; the last row of each run is carried to the next by a small table."""
    rows = log.withColumn("_run", F.floor(F.col(ordinal) / 100_000))
    last = rows.groupBy(*keys, "_run").agg(F.max_by(ts, ordinal).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_run"))).drop("_last")
    inside = Window.partitionBy(*keys, "_run").orderBy(ordinal)
    rows = rows.join(last, [*keys, "_run"]).withColumn("_before", F.coalesce(F.lag(ts).over(inside), F.col("_carry")))
    backs = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(ts).alias("n_ts"), F.sum(F.coalesce((F.col(ts) < F.col("_before")).cast("long"), F.lit(0))).alias("reversals"))
    distinct = with_previous(log.select(*keys, ts).distinct(), keys, ts)
    gaps = distinct.groupBy(*keys).agg(F.sum(F.coalesce((seconds(ts) - seconds("prev_ts") != step).cast("long"), F.lit(0))).alias("gaps"))
    return backs.join(gaps, keys).withColumn("duplicates", F.col("n_rows") - F.col("n_ts"))


def gap_class(before: Column, after: Column, step: int = 900, covered_from: Column | None = None, covered_to: Column | None = None, session: Column | None = None) -> Column:
    """What kind of gap lies between two neighbouring bars: NOT_A_GAP up to one step, SESSION_GAP at a session's border,
    REPLAY_DATA_GAP where the replay's quotes cover it, MISSING_DATA_GAP where they do not cover all of it, else
    MARKET_GAP (also where a neighbour is missing, or without coverage)."""
    found = F.when(before.isNull() | after.isNull(), "MARKET_GAP").when(seconds(after) - seconds(before) <= step, "NOT_A_GAP")
    if session is not None:
        found = found.when(session, "SESSION_GAP")
    if covered_from is not None and covered_to is not None:
        known = covered_from.isNotNull() & covered_to.isNotNull()
        inside = (before >= covered_from) & (after <= covered_to)
        found = found.when(known & inside, "REPLAY_DATA_GAP").when(known, "MISSING_DATA_GAP")
    return found.otherwise("MARKET_GAP")


def warmup_bars(fast_bars: int, hours: int, step: int = 900) -> int:
    """Bars before the first signal: the longest bar indicator, or as many confirmed hours and the one that shows them."""
    return max(fast_bars, (hours + 1) * 3600 // step)


def usable_segments(bars: DataFrame, keys: list[str], warmup: int, least: int, step: int = 900, ts: str = "ts") -> DataFrame:
    """Segments with the first bar that may trade, and why a segment is left out."""
    found = segments(bars, keys, step, ts)
    reason = F.when(F.col("candles") <= warmup, "shorter than warm-up").when(F.col("candles") - warmup < least, "too few bars after warm-up")
    first = F.col("segment_start") + F.make_dt_interval(secs=F.lit(warmup * step))
    return found.withColumns({"trade_start": F.when(reason.isNull(), first), "excluded": reason, "usable": reason.isNull()})


def off_grid(rows: DataFrame, step: int = 900, ts: str = "ts") -> DataFrame:
    return rows.filter(seconds(ts) % step != 0)


def finished(bars: DataFrame, now: Column, step: int = 900, ts: str = "ts") -> DataFrame:
    """Bars that have closed by ``now``."""
    return bars.filter(F.col(ts) + F.make_dt_interval(secs=F.lit(step)) <= now)


def freshness(last: Column, now: Column, live: Column | None = None, server: Column | None = None) -> Column:
    """How current a feed is. A stored one goes by its last bar (30 minutes), a live one by its server's clock (20
    seconds): ``live`` says which, ``server`` is the clock."""
    live, server = F.lit(False) if live is None else live, F.lit(None).cast("timestamp") if server is None else server
    age = seconds(now) - seconds(server)
    stored = F.when(seconds(now) - seconds(last) <= 1800, "HISTORICAL SNAPSHOT").otherwise("HISTORICAL \u00b7 STALE")
    current = F.when(server.isNull(), "LIVE CLOCK UNAVAILABLE").when(age.between(0, 20), "LIVE").otherwise("STALE LIVE FEED")
    return F.when(last.isNull(), F.when(live, "NOT CONNECTED").otherwise("NO DATA")).when(live, current).otherwise(stored)
