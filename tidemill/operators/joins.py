"""Joins in time: as-of, containment, overlap, first passage, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.carry import chunked, running
from tidemill.operators.segments import seconds


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], value: str, ts: str = "ts", chunk: int = 86_400, within: int | None = None) -> DataFrame:
    """Adds the value of the last right row at or before each left row, and (with ``within``) fewer seconds away; null
    where there is none. Ordered windows cover one chunk of time each;
    the last right row of earlier chunks is carried by a table with a row for each chunk."""
    piece = F.floor(seconds(ts) / chunk)
    names = left.columns
    rows = left.withColumns({"_side": F.lit(1), "_v": F.lit(None), "_p": piece})
    seen = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(ts, value).alias("_v"), piece.alias("_p"))
    rows = rows.withColumn("_v", F.lit(None).cast(seen.schema["_v"].dataType))
    both = rows.unionByName(seen, allowMissingColumns=True)
    chunks = both.groupBy(*keys, "_p").agg(F.max("_v").alias("_max"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "_p", F.max("_max").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_p").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.join(chunks, [*keys, "_p"]).withColumn("_found", F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")))
    if within is not None:
        joined = joined.withColumn("_found", F.when(seconds(ts) - seconds(f"_found.{ts}") < within, F.col("_found")))
    return joined.filter("_side = 1").select(*names, F.col(f"_found.{ts}").alias(f"asof_{ts}"), F.col(f"_found.{value}").alias(f"asof_{value}"))


def contained(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, ts: str = "ts", chunk: int = 86_400) -> DataFrame:
    """Pairs of intervals and the points inside them (both ends included): intervals are dealt to every chunk of time
    they touch, so the join is by equality of chunk and then filtered. It sorts, as both sides grow: Spark would broadcast one
    on an estimate made before the explode."""
    spans = F.sequence(F.floor(seconds(start) / chunk), F.floor(seconds(end) / chunk))
    dealt = intervals.withColumn("_p", F.explode(spans))
    placed = points.withColumn("_p", F.floor(seconds(ts) / chunk))
    return dealt.join(placed.hint("merge"), [*keys, "_p"]).filter(F.col(ts).between(F.col(start), F.col(end))).drop("_p")


def excursions(trades: DataFrame, bars: DataFrame, keys: list[str], trade_id: str = "trade_id") -> DataFrame:
    """Best and worst prices (and when they came first) while a trade is open, in units of its risk."""
    rows = contained(trades, bars.select(*keys, "ts", "high", "low"), keys, "entry_ts", "exit_ts")
    long = F.col("direction") == "LONG"
    best = F.when(long, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low"))
    worst = F.when(long, F.col("entry") - F.col("low")).otherwise(F.col("high") - F.col("entry"))
    rows = rows.withColumns({"_best": best, "_worst": worst})
    early = -seconds("ts")
    found = rows.groupBy(trade_id).agg(
        F.greatest(F.max("_best"), F.lit(0.0)).alias("mfe"), F.greatest(F.max("_worst"), F.lit(0.0)).alias("mae"),
        F.max_by("ts", F.struct("_best", early)).alias("mfe_ts"), F.max_by("ts", F.struct("_worst", early)).alias("mae_ts"), F.count("*").alias("bars_held"),
    )
    return trades.join(found, trade_id, "left")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left intervals (entry_ts, exit_ts) that overlap any right one: those for which the latest end of the right ones that
    begin by their end is not before their beginning. A running maximum says so, no pairs are made. Intervals without a
    key or an end overlap nothing."""
    whole = F.lit(True)
    for c in (*keys, "entry_ts", "exit_ts"):
        whole &= F.col(c).isNotNull()
    names = left.columns
    own = left.filter(whole).withColumns({"_at": F.col("exit_ts"), "_side": F.lit(1), "_to": F.lit(None).cast(right.schema["exit_ts"].dataType)})
    other = right.filter(whole).select(*keys, F.col("entry_ts").alias("_at"), F.lit(0).alias("_side"), F.col("exit_ts").alias("_to"))
    both = own.unionByName(other, allowMissingColumns=True)
    found = running(chunked(both, keys, ["_at", "_side"]), keys, ["_at", "_side"], maxima={"_last": F.col("_to")})
    return found.filter("_side = 1 and _last >= entry_ts").select(*names)


def first_passage(bars: DataFrame, keys: list[str], target: float, stop: float, horizon: int = 480, ts: str = "ts") -> DataFrame:
    """For every bar: whether ``target`` (above the close, in price units) or ``stop`` (below) is reached first within
    the next ``horizon`` bars of its segment; both on one bar count as AMBIGUOUS. The horizon bounds each window."""
    ahead = Window.partitionBy(*keys).orderBy(ts).rowsBetween(1, horizon)
    row = Window.partitionBy(*keys).orderBy(ts)
    own = bars.withColumn("_n", F.row_number().over(row))
    path = F.collect_list(F.struct("high", "low", "_n")).over(ahead)
    own = own.withColumn("_path", path)
    first = lambda test: F.array_min(F.transform(F.filter("_path", test), lambda x: x["_n"]))
    up = first(lambda x: x["high"] >= F.col("close") + target) - F.col("_n")
    down = first(lambda x: x["low"] <= F.col("close") - stop) - F.col("_n")
    own = own.withColumns({"bars_to_target": up, "bars_to_stop": down})
    t, s = F.col("bars_to_target"), F.col("bars_to_stop")
    label = F.when(t.isNull() & s.isNull(), "OPEN").when(s.isNull() | (t < s), "TARGET").when(t.isNull() | (s < t), "STOP").otherwise("AMBIGUOUS")
    return own.withColumn("resolution", label).drop("_path", "_n")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Full join of two versions by key: where each row is, which value first differs, and by how much."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(True).alias("_r"))
    joined = a.join(b, keys, "full")
    place = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    both = F.col("_l") & F.col("_r")

    def differs(v: str) -> Column:
        x, y = F.col(f"{v}_left"), F.col(f"{v}_right")
        return ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())

    first = F.coalesce(*[F.when(both & differs(v), v) for v in values])
    return joined.withColumns({"place": place, "first_difference": first}).drop("_l", "_r")


def key_delta(base: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each side by key: added, displaced or common, with the number of each."""
    a, b = base.select(*keys).distinct(), variant.select(*keys).distinct()
    parts = [(b.join(a, keys, "left_anti"), "added"), (a.join(b, keys, "left_anti"), "displaced"), (a.join(b, keys, "left_semi"), "common")]
    found = parts[0][0].withColumn("change", F.lit(parts[0][1]))
    for df, name in parts[1:]:
        found = found.unionByName(df.withColumn("change", F.lit(name)))
    return found.groupBy("change").agg(F.count("*").alias("n"))
