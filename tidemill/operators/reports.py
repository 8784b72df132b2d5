"""Grouped reports on trade logs and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import div
from tidemill.operators.carry import cumulative
from tidemill.operators.metrics import loss, trade_stats, win, with_equity


def by_period(trades: DataFrame, keys: list[str], period: Column, name: str, order: list[str], initial: float) -> DataFrame:
    """Statistics pooled over series by period; drawdowns stay within a series, and the largest one counts."""
    rows = trades.withColumn(name, period)
    drawdown = with_equity(rows, keys, order, initial).groupBy(name, *keys).agg(F.max("drawdown").alias("_d")).groupBy(name).agg(F.max("_d").alias("max_drawdown"))
    return trade_stats(rows, [name]).join(drawdown, name)


def reach_cube(trades: DataFrame, dimensions: list[str], value: str, levels: list[float]) -> DataFrame:
    """Count, median and the share that reaches each level, for every combination of the dimensions with 'All'."""
    shares = [F.avg(F.when(F.col(value) >= x, 1.0).otherwise(0.0)).alias(f"reach_{x:g}") for x in levels]
    flags = [F.grouping(c).alias(f"_{c}") for c in dimensions]
    found = trades.cube(*dimensions).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"), *shares, *flags)
    return found.withColumns({c: F.when(F.col(f"_{c}") == 1, "All").otherwise(F.col(c)) for c in dimensions}).drop(*[f"_{c}" for c in dimensions])


def cost_grid(trades: DataFrame, spreads: list[float], keys: list[str]) -> DataFrame:
    """Statistics with each of a few spreads taken from every trade's result (times its quantity)."""
    rows = trades.withColumn("spread", F.explode(F.array(*map(F.lit, spreads)))).withColumn("pnl", F.col("pnl") - F.col("spread") * F.col("quantity"))
    return trade_stats(rows, ["spread", *keys])


def tail_loss(trades: DataFrame, keys: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Mean of the worst share (rounded up) of each group, from the ranks of its distinct values."""
    most = F.ceil(F.col("total") * share)
    taken = F.greatest(F.least(F.col("n"), most - F.col("below")), F.lit(0))
    rows = cumulative(trades, keys, F.col(value)).withColumn("_taken", taken)
    return rows.groupBy(*keys).agg(div(F.sum(F.when(F.col("_taken") > 0, F.col("value") * F.col("_taken"))), F.sum("_taken")).alias("tail_mean"), F.sum("_taken").alias("n"))


def effect_sizes(trades: DataFrame, keys: list[str], features: list[str], pnl: str = "pnl") -> DataFrame:
    """Distance of winners' and losers' medians in units of the quartile range, for each feature."""
    rows = trades.unpivot([*keys, pnl], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    found = rows.groupBy(*keys, "feature").agg(
        F.percentile(F.when(win(pnl), F.col("value")), 0.5).alias("_w"), F.percentile(F.when(loss(pnl), F.col("value")), 0.5).alias("_l"), F.percentile("value", [0.25, 0.75]).alias("_q"),
    )
    return found.select(*keys, "feature", div(F.abs(F.col("_w") - F.col("_l")), F.col("_q")[1] - F.col("_q")[0]).alias("effect"))


def drift(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Periods, positive ones, and the mean absolute change from period to period (periods are few)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("_c", F.abs(F.col(value) - before))
    return rows.groupBy(*keys).agg(F.count("*").alias("months"), F.count(F.when(F.col(value) > 0, 1)).alias("positive"), F.avg("_c").alias("mean_change"))


def move_scaling(bars: DataFrame, keys: list[str], horizons: list[int], step: int) -> DataFrame:
    """Exponent of the mean absolute move as a power of the horizon, by a fit on logarithms. Each bar is dealt to the
    times it is compared with: a join by equality."""
    ahead = bars.select(*keys, F.col("close").alias("_from"), F.explode(F.array(*map(F.lit, horizons))).alias("h"), "ts")
    ahead = ahead.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("h") * step))
    found = ahead.join(bars.select(*keys, "ts", "close"), [*keys, "ts"]).groupBy("h").agg(F.avg(F.abs(F.col("close") - F.col("_from"))).alias("m"))
    x, y = F.log("h"), F.log("m")
    return found.agg(F.regr_slope(y, x).alias("exponent"), F.regr_intercept(y, x).alias("intercept"))


def rolling_months(trades: DataFrame, start: str, windows: int, months: int) -> DataFrame:
    """Trades and total R in windows of ``months`` that begin at each of ``windows`` months; a trade is dealt to the
    windows it falls into."""
    first = F.lit(start).cast("timestamp_ntz")
    month = (F.year("ts") - F.year(first)) * 12 + F.month("ts") - F.month(first)
    places = F.sequence(F.greatest(month - (months - 1), F.lit(0)), F.least(month, F.lit(windows - 1)))
    rows = trades.filter((month >= 0) & (month <= windows + months - 2)).withColumn("_k", F.explode(places))
    begin = first + F.make_ym_interval(F.lit(0), F.col("_k"))
    return rows.groupBy(begin.alias("window_start")).agg(F.count("*").alias("n"), F.sum("r").alias("total_r"))


def nearest_rank(rows: DataFrame, keys: list[str], value: Column, share: float = 0.95) -> DataFrame:
    """Nearest-rank quantile (half ranks to even) and the largest value of each group, from the ranks of its distinct
    values."""
    at = F.bround(F.lit(share) * (F.col("total") - 1), 0)
    here = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    return cumulative(rows, keys, value).groupBy(*keys).agg(F.max("total").alias("n"), F.max(F.when(here, F.col("value"))).alias("p95"), F.max("value").alias("worst"))
