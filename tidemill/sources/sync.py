"""Fetching what a stored history lacks: only absent ranges, in rounds, each an atomic append to the stored table.

A call that stops in the middle leaves the rounds that were committed; the next call finds what is still missing from the table
itself. Pages of a round are fetched by tasks, each with retries that wait longer each time and a least interval between
requests. A page with a row that is no candle, or outside its range, fails its round before anything of it is stored.
Empty answers stay gaps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.segments import seconds, with_previous

CANDLES = "epoch long, open double, high double, low double, close double, volume double"


def absent_ranges(bars: DataFrame, start: int, end: int, step: int = 900) -> DataFrame:
    """Half-open ranges (start, end) of epoch seconds within [start, end) in which a series (``ts``) has no bars: before its first,
    between, and after its last; the whole range of an empty series. ``start`` and ``end`` are rounded up to steps."""
    start, end = -(-start // step) * step, -(-end // step) * step
    one = F.lit(0).alias("_k")
    inside = bars.filter((seconds("ts") >= start) & (seconds("ts") < end)).select(one, "ts").distinct()
    linked = with_previous(inside, ["_k"]).select(F.coalesce(seconds("prev_ts") + step, F.lit(start)).alias("start"), seconds("ts").alias("end"))
    last = inside.agg(F.coalesce(F.max(seconds("ts")) + step, F.lit(start)).alias("start")).select("start", F.lit(end).cast("long").alias("end"))
    return linked.select(F.col("start").cast("long"), "end").union(last.select(F.col("start").cast("long"), "end")).filter("start < end")


def pages_of(ranges: DataFrame, page: int, step: int = 900) -> DataFrame:
    """The ranges in pages of at most ``page`` bars."""
    cut = ranges.select("end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(page * step).cast("long"))).alias("start"))
    return cut.select("start", F.least("end", F.col("start") + page * step).alias("end"))


class InvalidPage(ValueError):
    """An answer that holds something else than candles of its range."""


def checked(rows: list[tuple], start: int, end: int, step: int) -> list[tuple]:
    """The rows of a page, if each is a candle of its range and no time comes twice."""
    seen = set()
    for epoch, o, h, low, c, volume in rows:
        if not start <= epoch < end or epoch % step or epoch in seen:
            raise InvalidPage(f"{epoch} is not, or not once, a time of {start} to {end}")
        if not (0 < low <= min(o, c) and max(o, c) <= h < float("inf") and volume >= 0):
            raise InvalidPage(f"no candle at {epoch}")
        seen.add(epoch)
    return rows


def fetched(pages: DataFrame, fetch: Callable[[int, int], Iterator[tuple]], step: int, retries: int = 4, wait: float = 0.5, interval: float = 0.0) -> DataFrame:
    """The candles of all pages. ``fetch(start, end)`` gives rows of ``CANDLES`` of a half-open range; an OSError is tried again
    ``retries`` times, after ``wait`` seconds and twice as long each time; a task's requests are ``interval`` seconds apart
    at least."""

    def run(batches):
        before = None
        for batch in batches:
            for a, b in zip(batch.column("start").to_pylist(), batch.column("end").to_pylist(), strict=True):
                for attempt in range(retries + 1):
                    if before is not None and (rest := before + interval - time.monotonic()) > 0:
                        time.sleep(rest)
                    before = time.monotonic()
                    try:
                        rows = checked(list(fetch(a, b)), a, b, step)
                        break
                    except OSError:
                        if attempt == retries:
                            raise
                        time.sleep(wait * 2**attempt)
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.record_batch([pa.array(list(c), pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(columns)], [x.split()[0] for x in CANDLES.split(", ")])

    return pages.select("start", "end").mapInArrow(run, CANDLES)


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """The table so far, with ``ts``; empty where there is none."""
    try:
        rows = spark.read.schema(CANDLES).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], CANDLES)
    return rows.withColumn("ts", F.timestamp_seconds("epoch").cast("timestamp_ntz"))


def sync_history(
    spark: SparkSession, fetch: Callable[[int, int], Iterator[tuple]], path: str, start: int, end: int, step: int = 900, page: int = 1000,
    pages_a_round: int = 64, **how,
) -> dict[str, int]:
    """Fetches what the table at ``path`` lacks of [start, end) and appends it, a round of pages at a time. Returns how many
    pages were planned, rows were received and stored in all, and bars are still absent."""
    before = stored_history(spark, path)
    had = before.count()
    plan = pages_of(absent_ranges(before, start, end, step), page, step)
    todo = sorted(map(tuple, plan.collect()))  # two numbers for each request that is to be made
    for i in range(0, len(todo), pages_a_round):
        part = spark.createDataFrame(todo[i : i + pages_a_round], "start long, end long").repartition(min(16, len(todo) - i))
        fetched(part, fetch, step, **how).write.mode("append").parquet(path)
    after = stored_history(spark, path)
    now = after.count()
    absent = absent_ranges(after, start, end, step).agg(F.coalesce(F.sum((F.col("end") - F.col("start")) / step), F.lit(0)).cast("long")).first()[0]
    return {"pages": len(todo), "received": now - had, "stored": now, "absent": absent}

