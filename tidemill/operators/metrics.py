"""Statistics of trade logs: grouped metrics, drawdowns, streaks, buckets, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import div
from tidemill.operators.carry import chunked, numbered, running, with_overlap

EPS = 1e-9


def win(pnl: str = "pnl") -> Column:
    return F.col(pnl) > EPS


def loss(pnl: str = "pnl") -> Column:
    return F.col(pnl) < -EPS


def profit_factor(profit: Column, lost: Column, infinite: bool = True) -> Column:
    """Profit over loss; without losses infinite (or null) if there is profit, else null."""
    alone = F.lit(float("inf")) if infinite else F.lit(None).cast("double")
    return F.when(lost > 0, div(profit, lost)).when(profit > 0, alone)


def trade_stats(trades: DataFrame, keys: list[str], pnl: str = "pnl", r: str | None = None, infinite: bool = True) -> DataFrame:
    """Counts, win rate, profit factor, expectancy and extremes of each group, in one aggregation."""
    gain, lost = F.when(win(pnl), F.col(pnl)), F.when(loss(pnl), -F.col(pnl))
    aggregates = [
        F.count(pnl).alias("trades"), F.count(gain).alias("wins"), F.count(lost).alias("losses"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(lost), F.lit(0.0)).alias("gross_loss"), F.sum(pnl).alias("net"), F.avg(gain).alias("avg_win"), F.avg(-lost).alias("avg_loss"),
        F.max(pnl).alias("best"), F.min(pnl).alias("worst"),
    ]
    if r:
        aggregates += [F.avg(r).alias("avg_r"), F.percentile(r, 0.5).alias("median_r")]
    found = trades.groupBy(*keys).agg(*aggregates) if keys else trades.agg(*aggregates)
    return found.withColumns({
        "breakeven": F.col("trades") - F.col("wins") - F.col("losses"), "win_rate": div(F.col("wins") * 100.0, F.col("trades")),
        "profit_factor": profit_factor(F.col("gross_profit"), F.col("gross_loss"), infinite), "expectancy": div(F.col("net"), F.col("trades")),
    })


def with_equity(trades: DataFrame, keys: list[str], order: list[str], initial: float, pnl: str = "pnl") -> DataFrame:
    """Adds balance, peak, drawdown and drawdown percent on the curve of closed trades; the initial balance is its first
    point, and a null result counts as 0."""
    rows = running(chunked(trades, keys, order), keys, order, sums={"_sum": F.col(pnl)}).withColumn("balance", F.lit(float(initial)) + F.col("_sum"))
    rows = running(rows, keys, order, maxima={"_high": F.col("balance")}).withColumn("peak", F.greatest(F.lit(float(initial)), "_high"))
    rows = rows.drop("_chunk", "_sum", "_high")
    return rows.withColumns({"drawdown": F.col("peak") - F.col("balance"), "drawdown_percent": div((F.col("peak") - F.col("balance")) * 100, F.col("peak"))})


def max_drawdown(trades: DataFrame, keys: list[str], order: list[str], initial: float, pnl: str = "pnl") -> DataFrame:
    """Largest drawdown of each series, by amount and by percent."""
    rows = with_equity(trades, keys, order, initial, pnl)
    return rows.groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), F.max("drawdown_percent").alias("max_drawdown_percent"), F.max_by("balance", F.struct(*order)).alias("final_balance"))


def streaks(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl", breakeven_resets: bool = True) -> DataFrame:
    """Longest runs of wins and of losses. A breakeven ends both runs, or (``breakeven_resets`` false) leaves the run
    of losses as it is."""
    is_win, is_loss = F.coalesce(win(pnl), F.lit(False)), F.coalesce(loss(pnl), F.lit(False))
    ends_loss = ~is_loss if breakeven_resets else is_win
    rows = chunked(trades.select(*keys, *order, is_win.alias("_w"), is_loss.alias("_l"), ends_loss.alias("_e")), keys, order)
    rows = running(rows, keys, order, sums={"_gw": (~F.col("_w")).cast("int"), "_gl": F.col("_e").cast("int")})
    wins = rows.groupBy(*keys, "_gw").agg(F.sum(F.col("_w").cast("long")).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("max_wins"))
    losses = rows.groupBy(*keys, "_gl").agg(F.sum(F.col("_l").cast("long")).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("max_losses"))
    return wins.join(losses, keys)


def worst_rolling(trades: DataFrame, keys: list[str], order: list[str], n: int, value: str = "r") -> DataFrame:
    """Smallest sum of ``n`` trades in a row."""
    rows = with_overlap(numbered(trades.select(*keys, *order, value), keys, order, "_no"), "_no", n)
    w = Window.partitionBy(*keys, "_block").orderBy("_no").rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("_s", F.when(F.count(value).over(w) == n, F.sum(value).over(w)))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_own"), F.col("_s"))).alias("worst_rolling"))


def longest_recovery(trades: DataFrame, keys: list[str], order: list[str], value: str = "r") -> DataFrame:
    """Most trades from a peak of the running sum (0 before the first trade) until it is reached again; an
    unfinished recovery counts up to the last trade."""
    rows = running(chunked(trades.select(*keys, *order, value), keys, order), keys, order, sums={"_c": F.col(value), "_n": F.lit(1)})
    rows = running(rows, keys, order, maxima={"_high": F.col("_c")}, before=True)
    rows = rows.withColumn("_under", F.col("_c") < F.greatest(F.lit(0.0), "_high"))
    rows = running(rows, keys, order, maxima={"_peak": F.when(~F.col("_under"), F.col("_n"))}, before=True)
    peak = F.coalesce("_peak", F.lit(0))
    span = F.when(F.col("_under") | (peak < F.col("_n") - 1), F.col("_n") - peak).otherwise(0)
    return rows.withColumn("_span", span).groupBy(*keys).agg(F.max("_span").alias("longest_recovery"))


def grouping_report(rows: DataFrame, value: str, dimensions: dict[str, Column]) -> DataFrame:
    """Count, mean and exact percentiles of a value overall and by each dimension alone, in one pass of grouping sets."""
    named = rows.select(F.col(value).alias("_v"), *[c.alias(k) for k, c in dimensions.items()])
    named.createOrReplaceTempView("_grouping_report")
    sets = ", ".join(["()"] + [f"({k})" for k in dimensions])
    label = " ".join(f"when grouping({k}) = 0 then '{k}'" for k in dimensions)
    key = ", ".join(f"cast({k} as string)" for k in dimensions)
    return rows.sparkSession.sql(
        f"select case {label} else 'overall' end as dimension, coalesce({key}, 'all') as key, count(_v) as n, avg(_v) as mean, "
        f"min(_v) as low, max(_v) as high, percentile(_v, 0.5) as median, percentile(_v, 0.95) as p95 from _grouping_report group by grouping sets ({sets})"
    )


def bucketed(rows: DataFrame, value: str, edges: list[float], name: str = "bucket") -> DataFrame:
    """Label of the left-closed interval between fixed edges; the last one includes its end. Null outside."""
    label = F.lit(None).cast("string")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        inside = (F.col(value) >= lo) & ((F.col(value) <= hi) if i == len(edges) - 2 else (F.col(value) < hi))
        label = F.when(inside, f"{lo:g}-{hi:g}").otherwise(label)
    return rows.withColumn(name, label)


def quantile_bucketed(rows: DataFrame, value: str, parts: int = 4, name: str = "quantile") -> DataFrame:
    """Number of the right-closed quantile interval (from 1); edges are exact, and joined as one row."""
    edges = rows.agg(F.array_distinct(F.percentile(value, [i / parts for i in range(1, parts)])).alias("_edges"))
    joined = rows.crossJoin(F.broadcast(edges))  # one row
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1)).drop("_edges")


def winner_loser_profile(trades: DataFrame, features: list[str], pnl: str = "pnl") -> DataFrame:
    """Mean, median and quartiles of each feature for winners and for losers."""
    label = F.when(win(pnl), "winner").when(loss(pnl), "loser")
    rows = trades.withColumn("outcome", label).filter("outcome is not null")
    long = rows.unpivot(["outcome"], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    return long.groupBy("feature", "outcome").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"),
        F.percentile("value", 0.25).alias("p25"), F.percentile("value", 0.75).alias("p75"),
    )


def threshold_probe(trades: DataFrame, feature: str, thresholds: list[float], pnl: str = "pnl") -> DataFrame:
    """Trades kept, and their net, where the feature is at least each threshold: one pass of conditional sums."""
    aggregates = []
    for i, t in enumerate(thresholds):
        kept = F.col(feature) >= t
        aggregates += [F.count(F.when(kept, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(kept, F.col(pnl))), F.lit(0.0)).alias(f"s{i}")]
    one = trades.agg(F.count("*").alias("total"), *aggregates)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("kept"), F.col(f"s{i}").alias("net")) for i, t in enumerate(thresholds)])
    return one.select("total", F.inline(rows))


def funnel(events: DataFrame, order: list[str], stage: str = "stage", passed: str = "passed") -> DataFrame:
    """Entered and passed counts of each stage, and the share of the stage before (stages are few)."""
    rank = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    found = events.groupBy(stage).agg(F.count("*").alias("entered"), F.sum(F.col(passed).cast("long")).alias("passed"))
    found = found.withColumn("ordinal", F.try_element_at(rank, F.col(stage))).filter("ordinal is not null")
    before = F.lag("passed").over(Window.orderBy("ordinal"))
    return found.withColumn("conversion", div(F.col("passed") * 1.0, before))


def concentration(trades: DataFrame, ts: str, pnl: str = "pnl", top: int = 5) -> DataFrame:
    """The ``top`` months by net, with their share of all profit from profitable months."""
    months = trades.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.sum(pnl).alias("net"))
    total = months.agg(F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("_t"))
    return months.crossJoin(F.broadcast(total)).withColumn("share", div(F.col("net"), F.col("_t"))).drop("_t").orderBy(F.desc("net"), "month").limit(top)


def leave_one_out(trades: DataFrame, period: Column, pnl: str = "pnl") -> DataFrame:
    """Trades and net without each period, from sums by period."""
    parts = trades.groupBy(period.alias("dropped")).agg(F.count(pnl).alias("n"), F.sum(pnl).alias("net"))
    total = parts.agg(F.sum("n").alias("_n"), F.sum("net").alias("_net"))
    return parts.crossJoin(F.broadcast(total)).select("dropped", (F.col("_n") - F.col("n")).alias("n"), (F.col("_net") - F.col("net")).alias("net"))


def outlier_dependence(trades: DataFrame, order: list[str], value: str = "r", counts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Sum of results without the best 1, 3, 5 trades. Only the best rows are ranked; the rest are summed."""
    best = trades.orderBy(F.desc(value), *order).limit(max(counts)).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(value), *order)))
    top = best.agg(*[F.sum(F.when(F.col("_rank") <= k, F.col(value))).alias(f"top{k}") for k in counts])
    total = trades.agg(F.sum(value).alias("total"))
    rows = F.array(*[F.struct(F.lit(k).alias("removed"), (F.col("total") - F.col(f"top{k}")).alias("remaining"), div(F.col(f"top{k}"), F.col("total")).alias("top_share")) for k in counts])
    return total.crossJoin(top).select(F.inline(rows))
