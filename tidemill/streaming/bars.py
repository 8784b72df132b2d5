"""Bars from a stream of ticks, given out when the watermark closes their bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, keys: list[str], price: str = "price", width: str = "15 minutes", late: str = "10 minutes", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Open, high, low, close and ticks of each bucket of an event-time stream (column ``ts``, a timestamp), given out
    once when the watermark has passed the bucket's end; later ticks are dropped (``late`` is how late they may come).
    ``order`` settles ticks of one time; what then still ties goes by price. Also works on a static table."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    found = rows.groupBy(*keys, F.window("ts", width).alias("_w")).agg(
        F.min_by(price, F.struct(*order, price)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(*order, price)).alias("close"), F.count("*").alias("ticks"),
    )
    return found.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "ticks")
