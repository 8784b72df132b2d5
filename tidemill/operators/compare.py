"""Comparing two feeds, trade logs or audits: matching within tolerances and naming the differences."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.functions.candles import div
from tidemill.operators.segments import seconds


def differs(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Whether two text cells differ: not as text, nor as numbers within the tolerances. Nulls equal only nulls."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(x), F.abs(y)))
    return ~F.coalesce(a.eqNullSafe(b) | near, F.lit(False))


def first_divergence(left: DataFrame, right: DataFrame, keys: list[str], checks: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows of both audits with the first column, in the order of ``checks``, that differs beyond its tolerances."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, keys)
    tests = [(c, differs(F.col(f"a.{c}").cast("string"), F.col(f"b.{c}").cast("string"), *t)) for c, t in checks.items()]
    return joined.select(*keys, F.coalesce(*[F.when(t, F.lit(c)) for c, t in tests]).alias("divergence"))


def agreement(left: DataFrame, right: DataFrame, keys: list[str], checks: dict[str, tuple[float, float]]) -> DataFrame:
    """For each column: rows compared and rows that agree."""
    joined = left.alias("a").join(right.alias("b"), keys)
    parts = [F.sum((~differs(F.col(f"a.{c}").cast("string"), F.col(f"b.{c}").cast("string"), *t)).cast("long")).alias(c) for c, t in checks.items()]
    one = joined.agg(F.count("*").alias("compared"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("agree")) for c in checks])
    return one.select("compared", F.inline(rows))


def revision_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Changed cells of two versions of a table: one row for each, and rows that only one version has."""
    a = old.select(*keys, *[F.col(v).cast("string").alias(f"{v}_old") for v in values], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.col(v).cast("string").alias(f"{v}_new") for v in values], F.lit(True).alias("_b"))
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"{v}_old").alias("old"), F.col(f"{v}_new").alias("new")) for v in values])
    place = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("changed")
    rows = a.join(b, keys, "full").select(*keys, place.alias("change"), F.inline(cells))
    same = F.col("old").eqNullSafe(F.col("new"))
    rows = rows.withColumn("numeric_equal", F.coalesce(F.col("old").try_cast("double") == F.col("new").try_cast("double"), F.lit(False)))
    return rows.filter(~same)


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, left_id: str = "id", right_id: str = "id", ts: str = "ts") -> DataFrame:
    """One-to-one matches of rows with equal keys whose times are at most ``tolerance`` seconds apart; the left rows
    choose in order of time, each the nearest free right row (the earlier of equals).

    Rows farther apart than the tolerance cannot compete, so each key's time line falls into blocks at steps of more than the
    tolerance, and blocks are matched apart. A block is read once, in order of time, and about two tolerances of it are held;
    blocks without a gap are one task each."""
    from tidemill.operators.segments import running_count, with_previous

    a = left.select(*keys, F.col(ts).alias("ts"), F.col(left_id).cast("long").alias("id"), F.lit(0).alias("side"))
    b = right.select(*keys, F.col(ts).alias("ts"), F.col(right_id).cast("long").alias("id"), F.lit(1).alias("side"))
    both = a.union(b)
    stamps = with_previous(both.select(*keys, "ts").distinct(), keys, "ts")
    cut = F.when(seconds("ts") - seconds("prev_ts") <= tolerance, 0).otherwise(1)
    blocks = running_count(stamps, cut, keys, "ts", "block").drop("prev_ts")
    rows = both.join(blocks, [*keys, "ts"]).withColumn("at", seconds("ts")).withColumn("_k", F.struct(*keys, "block"))
    dealt = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "at", "side", "id")
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in ("left_id", "right_id", "gap")]])
    arrow = to_arrow_schema(schema)

    def match(batches):
        block, free, found = None, Free(tolerance), []
        for batch in batches:
            held = [batch.column(n).to_pylist() for n in ("_k", "side", "at", "id")]
            for key, side, at, own in zip(*held, strict=True):
                if key != block:
                    found += free.rest()
                    block, free = key, Free(tolerance, tuple(key[k] for k in keys))
                found += free.add(side, at, own)
            if len(found) > 10_000:
                yield _rows(found, arrow)
                found = []
        yield _rows(found + free.rest(), arrow)

    return dealt.select("_k", "side", "at", "id").mapInArrow(match, schema)


def _rows(found: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * len(arrow)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


class Free:
    """The free right rows around the left rows that still wait for later ones, of one block in order of time. Rows that are out of
    every waiting row's reach are forgotten, so it holds two tolerances of time."""

    def __init__(self, tolerance: int, key: tuple = ()):
        self.tolerance, self.key = tolerance, key
        self.at, self.ids, self.waiting = [], [], deque()

    def add(self, side: int, at: int, own: int) -> list[tuple]:
        """Takes the next row; gives the matches of left rows that nothing to come can reach."""
        found = []
        while self.waiting and at > self.waiting[0][0] + self.tolerance:
            found += self._choose(*self.waiting.popleft())
        if side == 0:
            self.waiting.append((at, own))
        else:
            self.at.append(at)
            self.ids.append(own)
        return found

    def rest(self) -> list[tuple]:
        found = []
        while self.waiting:
            found += self._choose(*self.waiting.popleft())
        return found

    def _choose(self, at: int, own: int) -> list[tuple]:
        gone = bisect_left(self.at, at - self.tolerance)  # left rows come in order of time
        del self.at[:gone], self.ids[:gone]
        i = bisect_left(self.at, at)
        low = bisect_left(self.at, self.at[i - 1]) if i else None  # the earliest of equal times
        high = i if i < len(self.at) and self.at[i] - at <= self.tolerance else None
        if low is None and high is None:
            return []
        best = high if low is None or (high is not None and self.at[high] - at < at - self.at[low]) else low
        gap = abs(self.at.pop(best) - at)
        return [(*self.key, own, self.ids.pop(best), gap)]


def trade_difference(spread: float = 0.0, tolerance: float = 1e-9) -> Column:
    """Why two matched trades differ, for columns ``entry_left``, ``entry_right``, ``exit_left``, ``exit_right``."""
    entry, exit_ = (F.abs(F.col(f"{x}_left") - F.col(f"{x}_right")) for x in ("entry", "exit"))
    return (
        F.when((entry <= tolerance) & (exit_ <= tolerance), "IDENTICAL").when((entry <= spread + tolerance) & (exit_ <= spread + tolerance), "SPREAD")
        .when(entry <= tolerance, "EXIT").when(exit_ <= tolerance, "ENTRY").otherwise("FEED")
    )


def price_effects(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Distribution of the differences of each value over common keys."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    b = right.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    cells = F.array(*[F.struct(F.lit(v).alias("field"), (F.col(f"{v}_b") - F.col(f"{v}_a")).alias("delta")) for v in values])
    rows = a.join(b, keys).select(F.inline(cells))
    return rows.groupBy("field").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.percentile("delta", 0.5).alias("median"), F.percentile(F.abs("delta"), 0.95).alias("p95_abs"), F.max(F.abs("delta")).alias("largest"))


def feed_similarity(left: DataFrame, right: DataFrame, key: str = "ts") -> DataFrame:
    """Correlation of levels, and share of equal directions of change, over common times of two feeds (``close``)."""
    joined = left.select(key, F.col("close").alias("a")).join(right.select(key, F.col("close").alias("b")), key)
    return joined.agg(F.count("*").alias("n"), F.corr("a", "b").alias("level"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_gap"), F.avg(div(F.abs(F.col("a") - F.col("b")), F.col("a"))).alias("mean_gap_share"))
