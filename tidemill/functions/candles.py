"""Expressions on one candle, and on prices, costs and sizes. All are Spark columns; nulls give null unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (also under ANSI rules)."""
    return F.try_divide(a, b)


def span(high="high", low="low") -> Column:
    return col(high) - col(low)


def body_share(open_="open", high="high", low="low", close="close") -> Column:
    """Body as a share of the range; 0 for a candle without range."""
    return F.when(span(high, low) > 0, div(F.abs(col(close) - col(open_)), span(high, low))).otherwise(0.0)


def close_location(high="high", low="low", close="close") -> Column:
    """Place of the close in the range, 0 to 1; null without range."""
    return F.when(span(high, low) > 0, div(col(close) - col(low), span(high, low)))


def upper_wick(open_="open", high="high", low="low", close="close") -> Column:
    return F.when(span(high, low) > 0, div(col(high) - F.greatest(col(open_), col(close)), span(high, low))).otherwise(0.0)


def lower_wick(open_="open", high="high", low="low", close="close") -> Column:
    return F.when(span(high, low) > 0, div(F.least(col(open_), col(close)) - col(low), span(high, low))).otherwise(0.0)


def invalid_ohlcv() -> Column:
    """Null, not finite, not positive, or extremes that do not enclose open and close; negative volume."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad = F.lit(False)
    for p in [*prices, F.col("volume")]:
        bad |= p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    for p in prices:
        bad |= p <= 0
    bad |= F.col("high") < F.greatest("open", "close", "low")
    bad |= F.col("low") > F.least("open", "close", "high")
    return F.coalesce(bad | (F.col("volume") < 0), F.lit(True))


def slipped(price: Column, direction: Column, percent: float, entry: bool = True) -> Column:
    """Price after slippage against the trade: up for buying, down for selling."""
    buying = (direction == "LONG") if entry else (direction == "SHORT")
    return price * F.when(buying, 1 + percent / 100).otherwise(1 - percent / 100)


def position_size(
    balance: Column, entry: Column, stop: Column, risk_percent: float = 1.0, leverage: float | None = None,
    commission_percent: float = 0.0,
) -> Column:
    """Quantity whose loss at the stop, commission of both sides included, is the risk budget; capped by leverage."""
    loss = F.abs(entry - stop) + commission_percent / 100 * (entry + stop)
    quantity = div(balance * risk_percent / 100, loss)
    return quantity if leverage is None else F.least(quantity, div(balance * leverage, entry))


def floor_to_step(volume: Column, step: float) -> Column:
    """Volume rounded down to whole steps, in decimals."""
    exact = F.lit(str(step)).cast("decimal(20,8)")
    return (F.floor(volume.cast("decimal(28,8)") / exact).cast("decimal(20,0)") * exact).cast("double")


def breakeven_win_rate(reward: Column) -> Column:
    """Win rate at which trades with that reward for a risk of 1 break even."""
    return div(F.lit(1.0), 1 + reward)


def change_percent(before: Column, after: Column) -> Column:
    """Percent change; null where the base is null or 0."""
    return F.when(before != 0, div(after - before, F.abs(before)) * 100)


def binomial_tail(successes: Column, trials: Column, p: float) -> Column:
    """P(X >= successes) for a binomial variable, summed from log terms."""
    import math

    log_p, log_q = math.log(p), math.log1p(-p)

    def log_factorial(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))

    def term(k: Column) -> Column:
        choose = log_factorial(trials) - log_factorial(k) - log_factorial(trials - k)
        return F.exp(choose + k * log_p + (trials - k) * log_q)

    total = F.aggregate(F.sequence(successes, trials), F.lit(0.0), lambda acc, k: acc + term(k))
    return F.when(successes <= 0, 1.0).when(successes > trials, 0.0).otherwise(F.least(total, F.lit(1.0)))


def outcome(pnl: Column, eps: float = 1e-9) -> Column:
    """WIN, LOSS or BREAKEVEN; values within ``eps`` of 0 break even."""
    return F.when(pnl > eps, "WIN").when(pnl < -eps, "LOSS").when(pnl.isNotNull(), "BREAKEVEN")
