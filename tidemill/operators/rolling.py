"""Rolling features of bars. Every window is bounded and stays inside one series (``keys`` include the segment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.functions.candles import div


def over(keys: list[str], lo: int, hi: int, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts).rowsBetween(lo, hi)


def full(value: Column, window: WindowSpec, n: int) -> Column:
    """``value`` where the window holds ``n`` rows, else null."""
    return F.when(F.count(F.lit(1)).over(window) == n, value)


def previous_extremes(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Highest high and lowest low of the ``n`` bars before this one; null with fewer."""
    w = over(keys, -n, -1)
    return bars.withColumns({f"prev_high_{n}": full(F.max("high").over(w), w, n), f"prev_low_{n}": full(F.min("low").over(w), w, n)})


def structural_stop(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Lowest low and highest high of the last ``n`` bars, this one included."""
    w = over(keys, -(n - 1), 0)
    return bars.withColumns({f"low_{n}": F.min("low").over(w), f"high_{n}": F.max("high").over(w)})


def true_range(keys: list[str]) -> Column:
    before = F.lag("close").over(Window.partitionBy(*keys).orderBy("ts"))
    wide = F.col("high") - F.col("low")
    return F.when(before.isNull(), wide).otherwise(F.greatest(wide, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def sma_atr(bars: DataFrame, keys: list[str], n: int = 14) -> DataFrame:
    """Simple mean of the true range over ``n`` bars; null until there are as many."""
    w = over(keys, -(n - 1), 0)
    rows = bars.withColumn("tr", true_range(keys))
    return rows.withColumn("sma_atr", full(F.avg("tr").over(w), w, n))


def directional_efficiency(bars: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """Net move over ``n`` bars as a share of the path."""
    order = Window.partitionBy(*keys).orderBy("ts")
    rows = bars.withColumn("_d", F.abs(F.col("close") - F.lag("close").over(order)))
    w = over(keys, -(n - 1), 0)
    net = F.abs(F.col("close") - F.lag("close", n).over(order))
    return rows.withColumn("efficiency", div(net, F.sum("_d").over(w))).drop("_d")


def reversal_frequency(bars: DataFrame, keys: list[str], n: int = 19) -> DataFrame:
    """Sign changes of the close-to-close move in the last ``n`` moves, as a share."""
    order = Window.partitionBy(*keys).orderBy("ts")
    rows = bars.withColumn("_s", F.signum(F.col("close") - F.lag("close").over(order)))
    rows = rows.withColumn("_f", F.when(F.col("_s") * F.lag("_s").over(order) < 0, 1.0).otherwise(0.0))
    w = over(keys, -(n - 1), 0)
    return rows.withColumn("reversals", full(F.avg("_f").over(w), w, n)).drop("_s", "_f")


def percentile_rank(bars: DataFrame, keys: list[str], value: str, n: int = 96, least: int = 20) -> DataFrame:
    """Share of the last ``n`` values (this one included) that are at most this one; null with fewer than ``least``."""
    w = over(keys, -(n - 1), 0)
    seen = F.collect_list(value).over(w)
    rows = bars.withColumn("_seen", seen)
    share = F.size(F.filter("_seen", lambda x: x <= F.col(value))) / F.size("_seen")
    return rows.withColumn(f"{value}_rank", F.when(F.size("_seen") >= least, share)).drop("_seen")


def realised_volatility(bars: DataFrame, keys: list[str], n: int = 96) -> DataFrame:
    """Sample deviation of log returns over ``n`` bars, scaled by the root of ``n``."""
    order = Window.partitionBy(*keys).orderBy("ts")
    rows = bars.withColumn("_r", F.log(div(F.col("close"), F.lag("close").over(order))))
    w = over(keys, -(n - 1), 0)
    return rows.withColumn("realised_vol", F.when(F.count("_r").over(w) == n, F.stddev_samp("_r").over(w) * float(n) ** 0.5)).drop("_r")


def pivot_highs(bars: DataFrame, keys: list[str], left: int = 2, right: int = 2) -> DataFrame:
    """Confirmed pivots: a high above the ``left`` highs before it and not below the ``right`` after it. Known ``right``
    bars later: ``pivot_level`` is the last confirmed one, ``pivot_age`` the bars since it."""
    order = Window.partitionBy(*keys).orderBy("ts")
    mid = F.lag("high", right).over(order)
    test = mid.isNotNull()
    for i in range(1, left + 1):
        test &= mid > F.lag("high", right + i).over(order)
    for i in range(right):
        test &= mid >= F.lag("high", i).over(order)
    rows = bars.withColumns({"_n": F.row_number().over(order), "_mid": mid, "_hit": F.coalesce(test, F.lit(False))})
    carried = order.rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("_hit"), F.struct("_mid", "_n")), ignorenulls=True).over(carried)
    rows = rows.withColumn("_at", at).withColumns({"is_pivot": F.col("_hit"), "pivot_level": F.col("_at._mid"), "pivot_age": F.col("_n") - F.col("_at._n") + right})
    return rows.drop("_n", "_mid", "_hit", "_at")


def bars_since(rows: DataFrame, keys: list[str], test: Column, name: str) -> DataFrame:
    """Bars since ``test`` last held on an earlier bar; null if it never did."""
    order = Window.partitionBy(*keys).orderBy("ts")
    rows = rows.withColumns({"_n": F.row_number().over(order), "_t": test})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.col("_n") - F.last(F.when(F.col("_t"), F.col("_n")), ignorenulls=True).over(before)).drop("_n", "_t")


def adjacent_return(bars: DataFrame, keys: list[str], step: int = 900) -> DataFrame:
    """Percent change against the bar before, only where that is exactly one step away."""
    from tidemill.operators.segments import seconds, with_previous

    rows = with_previous(bars, keys, "ts", "close")
    near = seconds("ts") - seconds("prev_ts") == step
    return rows.withColumn("ret", F.when(near, div(F.col("close"), F.col("prev_close")) - 1)).drop("prev_ts", "prev_close")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last known value of each column, in order, within each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
