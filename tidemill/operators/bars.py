"""Bars: from ticks or shorter bars by time bucket, with rules for completeness, and context of longer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.segments import seconds, with_segments


def bucket(ts: str, width: int) -> Column:
    """Start of the bucket of ``width`` seconds, without a zone."""
    return F.timestamp_seconds(seconds(ts) - seconds(ts) % width).cast("timestamp_ntz")


def ohlc(ticks: DataFrame, keys: list[str], price: Column, order: list[str], width: int = 900, ts: str = "ts", volume: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume and ticks of each bucket; ``order`` breaks ties of time. Combined before the shuffle."""
    rows = ticks.select(*keys, bucket(ts, width).alias("bar_ts"), price.alias("_p"), F.struct(*order).alias("_o"), (F.lit(1.0) if volume is None else volume).alias("_v"))
    found = rows.groupBy(*keys, "bar_ts").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"),
        F.sum("_v").alias("volume"), F.count("*").alias("ticks"),
    )
    return found.withColumnRenamed("bar_ts", "ts")


def upsample(bars: DataFrame, keys: list[str], width: int, ts: str = "ts") -> DataFrame:
    """Longer bars from shorter ones, with the number of parts and the first and last part's time."""
    rows = bars.withColumns({"_b": bucket(ts, width)})
    found = rows.groupBy(*keys, "_b").agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("parts"), F.count_distinct(ts).alias("distinct_parts"),
        F.min(ts).alias("first_part"), F.max(ts).alias("last_part"),
    )
    return found.withColumnRenamed("_b", "ts")


def complete(bars: DataFrame, keys: list[str], width: int, part: int) -> DataFrame:
    """Longer bars of which every part is there, at its exact place."""
    n = width // part
    found = upsample(bars, keys, width).filter((F.col("parts") == n) & (F.col("distinct_parts") == n))
    inside = (F.col("first_part") == F.col("ts")) & (seconds("last_part") - seconds("ts") == width - part)
    return found.filter(inside & (F.pmod(seconds("first_part"), F.lit(part)) == 0)).drop("distinct_parts", "first_part", "last_part")


def quote_bars(ticks: DataFrame, keys: list[str], order: list[str], width: int = 900, ts: str = "ts") -> DataFrame:
    """Bid and ask bars of a quote stream, with the spread's open, median, mean and maximum."""
    rows = ticks.withColumns({"_b": bucket(ts, width), "_o": F.struct(*order), "_s": F.col("ask") - F.col("bid")})
    aggregates = [F.count("*").alias("ticks"), F.min_by("_s", "_o").alias("spread_open"), F.percentile("_s", 0.5).alias("spread_median"),
                  F.avg("_s").alias("spread_mean"), F.max("_s").alias("spread_max")]
    for side in ("bid", "ask"):
        aggregates += [F.min_by(side, "_o").alias(f"{side}_open"), F.max(side).alias(f"{side}_high"), F.min(side).alias(f"{side}_low"), F.max_by(side, "_o").alias(f"{side}_close")]
    return rows.groupBy(*keys, "_b").agg(*aggregates).withColumnRenamed("_b", "ts")


def downsample_by_count(bars: DataFrame, keys: list[str], factor: int, ts: str = "ts") -> DataFrame:
    """Bars of ``factor`` consecutive bars each (for charts of one bounded series)."""
    order = Window.partitionBy(*keys).orderBy(ts)
    rows = bars.withColumn("_g", F.floor((F.row_number().over(order) - 1) / factor))
    found = rows.groupBy(*keys, "_g").agg(F.min(ts).alias("ts"), F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"))
    return found.drop("_g")


def hour_context(bars: DataFrame, keys: list[str], part: int = 900, ts: str = "ts") -> DataFrame:
    """Each bar with the last complete hour strictly before its own, in its continuous segment: ``h1_ts``, ``h1_close``.

    A complete hour becomes visible at the next hour's first bar and stays until a later one does, so it is joined by
    equality on that hour and carried forward; no range join is needed."""
    labelled = with_segments(bars, keys, part, ts)
    own = [*keys, "segment_id"]
    hours = complete(labelled, own, 3600, part).select(*own, (F.col("ts") + F.expr("interval 1 hour")).alias("_hour"), F.col("ts").alias("_h1"), F.col("close").alias("_close"))
    joined = labelled.withColumn("_hour", bucket(ts, 3600)).join(hours, [*own, "_hour"], "left")
    carried = Window.partitionBy(*own).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    row = F.last(F.when(F.col("_h1").isNotNull(), F.struct("_h1", "_close")), ignorenulls=True).over(carried)
    found = joined.withColumn("_ctx", row)
    return found.withColumns({"h1_ts": F.col("_ctx._h1"), "h1_close": F.col("_ctx._close")}).drop("_hour", "_h1", "_close", "_ctx")
