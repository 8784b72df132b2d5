"""Gaps and islands in time series, without a window over a whole series.

A series can have any length, so ordered windows run over (key, day) only; what must cross days (the last bar of the
day before, the number of breaks so far) is carried by a table with one row for each key and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 900


def seconds(ts: str | Column) -> Column:
    """Whole seconds since the epoch of a timestamp with or without a zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


def with_previous(bars: DataFrame, keys: list[str], ts: str = "ts", value: str | None = None) -> DataFrame:
    """Adds ``prev_ts`` (and ``prev_<value>``): the bar before in the same series."""
    day = F.to_date(ts)
    bars = bars.withColumn("_day", day)
    kept = [ts] if value is None else [ts, value]
    row = F.struct(*kept)
    last = bars.groupBy(*keys, "_day").agg(F.max(row).alias("_last"))
    by_day = Window.partitionBy(*keys).orderBy("_day")
    last = last.withColumn("_before", F.lag("_last").over(by_day)).drop("_last")
    inside = Window.partitionBy(*keys, "_day").orderBy(ts)
    joined = bars.join(last, [*keys, "_day"])
    previous = F.coalesce(F.lag(row).over(inside), F.col("_before"))
    joined = joined.withColumn("_prev", previous).withColumn("prev_ts", F.col(f"_prev.{ts}"))
    if value is not None:
        joined = joined.withColumn(f"prev_{value}", F.col(f"_prev.{value}"))
    return joined.drop("_prev", "_before", "_day")


def running_count(rows: DataFrame, flag: Column, keys: list[str], ts: str, name: str) -> DataFrame:
    """Adds the number of rows up to and including this one for which ``flag`` is 1, in order of time."""
    rows = rows.withColumns({"_day": F.to_date(ts), "_flag": flag.cast("long")})
    days = rows.groupBy(*keys, "_day").agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(days, [*keys, "_day"])
    return joined.withColumn(name, F.col("_base") + F.sum("_flag").over(inside)).drop("_day", "_flag", "_base")


def with_segments(bars: DataFrame, keys: list[str], step: int = STEP, ts: str = "ts") -> DataFrame:
    """Adds ``segment_id`` (from 1): a new one begins wherever the step from the bar before is not ``step`` seconds."""
    linked = with_previous(bars, keys, ts)
    breaks = F.when(seconds(ts) - seconds("prev_ts") == step, 0).otherwise(1)
    return running_count(linked, breaks, keys, ts, "segment_id").drop("prev_ts")


def segments(bars: DataFrame, keys: list[str], step: int = STEP, ts: str = "ts") -> DataFrame:
    """Continuous segments: start, end, candles."""
    found = with_segments(bars, keys, step, ts).groupBy(*keys, "segment_id")
    return found.agg(F.min(ts).alias("segment_start"), F.max(ts).alias("segment_end"), F.count("*").alias("candles"))


def missing_gaps(found: DataFrame, keys: list[str], step: int = STEP) -> DataFrame:
    """Gaps between segments: the missing range and its number of candles."""
    order = Window.partitionBy(*keys).orderBy("segment_start")
    after = found.withColumn("_next", F.lead("segment_start").over(order)).filter("_next is not null")
    missing = (seconds("_next") - seconds("segment_end")) / step - 1
    at = F.make_dt_interval(secs=F.lit(step))
    return after.select(*keys, (F.col("segment_end") + at).alias("gap_start"), (F.col("_next") - at).alias("gap_end"), missing.cast("long").alias("missing"))


def largest_segment(found: DataFrame, keys: list[str]) -> DataFrame:
    """The segment with the most candles of each series; the earliest of equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("candles"), "segment_start")
    return found.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def gap_bucket(missing: Column) -> Column:
    return F.when(missing == 1, "1").when(missing <= 4, "2-4").when(missing <= 16, "5-16").otherwise("17+")


def missing_calendar(bars: DataFrame, keys: list[str], step: int = STEP, ts: str = "ts") -> DataFrame:
    """Expected timestamps, from a series' first bar to its last, that have no bar. The calendar is made day by day, and
    each day's part meets only that day's bars."""
    ends = bars.groupBy(*keys).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    days = ends.select("*", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))).alias("_day"))
    start = F.col("_day").cast("timestamp_ntz")
    stamps = F.sequence(start, start + F.expr("interval '23:59:59' hour to second"), F.make_dt_interval(secs=F.lit(step)))
    calendar = days.select(*keys, "_from", "_to", F.explode(stamps).alias(ts)).filter(f"{ts} between _from and _to")
    return calendar.select(*keys, ts).join(bars.select(*keys, ts).distinct(), [*keys, ts], "left_anti")


def quality_report(bars: DataFrame, keys: list[str], step: int = STEP, ts: str = "ts") -> DataFrame:
    """Rows, distinct timestamps, duplicates, invalid candles, expected and missing candles of each series."""
    from tidemill.functions.candles import invalid_ohlcv

    counts = bars.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_distinct(ts).alias("n_ts"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.sum(invalid_ohlcv().cast("long")).alias("invalid"), F.sum((seconds(ts) % step != 0).cast("long")).alias("off_grid"),
    )
    expected = ((seconds("last_ts") - seconds("first_ts")) / step + 1).cast("long")
    return counts.withColumns({"duplicates": F.col("n_rows") - F.col("n_ts"), "expected": expected}).withColumn("missing", F.col("expected") - F.col("n_ts"))


def dedupe_keep_last(rows: DataFrame, keys: list[str], ordinal: str, ts: str = "ts", tie: Column | None = None) -> DataFrame:
    """One row for each key and timestamp: the one of the highest ordinal, and of equal ordinals that of the highest ``tie``
    (any of them without it)."""
    kept = [c for c in rows.columns if c not in (*keys, ts)]
    rank = F.col(ordinal) if tie is None else F.struct(F.col(ordinal), tie.alias("_tie"))
    best = rows.groupBy(*keys, ts).agg(F.max_by(F.struct(*kept), rank).alias("_row"))
    return best.select(*keys, ts, "_row.*")


def month_coverage(bars: DataFrame, keys: list[str], step: int = STEP, ts: str = "ts") -> DataFrame:
    """Observed and possible candles of each month."""
    month = F.date_format(ts, "yyyy-MM")
    found = bars.groupBy(*keys, month.alias("month")).agg(F.count_distinct(ts).alias("observed"))
    days = F.day(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    return found.withColumn("expected", (days * 86400 / step).cast("long")).withColumn("coverage", F.col("observed") / F.col("expected"))
