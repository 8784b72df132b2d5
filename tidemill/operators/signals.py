"""Bar signals as column expressions: crossovers, breakouts, sweeps and overshoots.

Inputs are bars with the columns of ``with_indicators`` and ``previous_extremes``; outputs are ``direction``, ``trigger``,
``stop`` and ``expiry``. Thresholds are parameters; a null input gives no signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import body_share, close_location, div, span


def _with(rows: DataFrame, long: Column, short: Column, trigger_long, stop_long, trigger_short, stop_short, expiry: int) -> DataFrame:
    none = F.lit(None).cast("double")
    side = F.when(F.coalesce(long, F.lit(False)), "LONG").when(F.coalesce(short, F.lit(False)), "SHORT")
    pick = lambda a, b: F.when(side == "LONG", none if a is None else a).when(side == "SHORT", none if b is None else b)
    return rows.withColumns({"direction": side, "trigger": pick(trigger_long, trigger_short).cast("double"), "stop": pick(stop_long, stop_short), "expiry": F.lit(expiry)})


def ema_cross(rows: DataFrame, keys: list[str], warmup: int = 50, stop_atr: float = 1.5) -> DataFrame:
    """Market signal where the fast mean crosses the slow one, from bar ``warmup`` of the series on."""
    order = Window.partitionBy(*keys).orderBy("ts")
    gap = F.col("ema_fast") - F.col("ema_slow")
    rows = rows.withColumns({"_g": gap, "_n": F.row_number().over(order)}).withColumn("_p", F.lag("_g").over(order))
    ready = (F.col("_n") >= warmup) & F.col("atr").isNotNull()
    found = _with(rows, ready & (F.col("_p") <= 0) & (F.col("_g") > 0), ready & (F.col("_p") >= 0) & (F.col("_g") < 0), None,
                  F.col("close") - stop_atr * F.col("atr"), None, F.col("close") + stop_atr * F.col("atr"), 1)
    return found.drop("_g", "_p", "_n")


def breakout(rows: DataFrame, keys: list[str], n: int = 5, adx: float = 18.0, body: float = 0.5, buffer: float = 0.05, stop_buffer: float = 0.2, expiry: int = 3) -> DataFrame:
    """Trend breakout: a strong candle closes beyond the last ``n`` bars' extreme, with the means and strength in line."""
    order = Window.partitionBy(*keys).orderBy("ts")
    two = order.rowsBetween(-1, 0)
    rows = rows.withColumns({"_lo": F.min("low").over(two), "_hi": F.max("high").over(two)})
    size = div(span(), F.col("atr"))
    common = (F.col("adx") >= adx) & (body_share() >= body) & size.between(0.6, 2.75) & (div(F.abs(F.col("close") - F.col("ema_fast")), F.col("atr")) <= 2.5)
    long = common & (F.col("ema_fast") > F.col("ema_slow")) & F.col("rsi").between(50, 75) & (F.col("close") > F.col("open")) & (F.col("close") > F.col(f"prev_high_{n}"))
    short = common & (F.col("ema_fast") < F.col("ema_slow")) & F.col("rsi").between(25, 50) & (F.col("close") < F.col("open")) & (F.col("close") < F.col(f"prev_low_{n}"))
    unit = F.col("atr")
    found = _with(rows, long, short, F.col("high") + buffer * unit, F.col("_lo") - stop_buffer * unit, F.col("low") - buffer * unit, F.col("_hi") + stop_buffer * unit, expiry)
    return found.drop("_lo", "_hi")


def sweep(rows: DataFrame, n: int = 8, least: float = 0.05, most: float = 0.8, body: float = 0.35, rsi: float = 46.0, expiry: int = 3) -> DataFrame:
    """Range reversal: a bar pierces the last ``n`` bars' extreme a little and closes back inside."""
    unit = F.col("atr")
    down, up = div(F.col(f"prev_low_{n}") - F.col("low"), unit), div(F.col("high") - F.col(f"prev_high_{n}"), unit)
    strong = body_share() >= body
    long = down.between(least, most) & (F.col("close") > F.col(f"prev_low_{n}")) & (F.col("close") > F.col("open")) & strong & (F.col("rsi") <= rsi)
    short = up.between(least, most) & (F.col("close") < F.col(f"prev_high_{n}")) & (F.col("close") < F.col("open")) & strong & (F.col("rsi") >= 100 - rsi)
    return _with(rows, long, short, F.col("high") + 0.05 * unit, F.col("low") - 0.2 * unit, F.col("low") - 0.05 * unit, F.col("high") + 0.2 * unit, expiry)


def overshoot(rows: DataFrame, n: int = 8, adx: float = 20.0, near: float = 1.0, far: float = 4.0, location: float = 0.6, expiry: int = 3) -> DataFrame:
    """Mean reversion: far from the fast mean in a quiet market, beyond the last extreme, closing in the upper part."""
    unit = F.col("atr")
    away = div(F.abs(F.col("close") - F.col("ema_fast")), unit)
    common = (F.col("adx") <= adx) & away.between(near, far)
    middle = (F.col("high") + F.col("low")) / 2
    long = common & (F.col("close") < F.col("ema_fast")) & (F.col("close") > F.col("open")) & (F.col("low") < F.col(f"prev_low_{n}")) & (F.col("close") > middle) & (close_location() >= location)
    short = common & (F.col("close") > F.col("ema_fast")) & (F.col("close") < F.col("open")) & (F.col("high") > F.col(f"prev_high_{n}")) & (F.col("close") < middle) & (close_location() <= 1 - location)
    return _with(rows, long, short, F.col("high") + 0.05 * unit, F.col("low") - 0.2 * unit, F.col("low") - 0.05 * unit, F.col("high") + 0.2 * unit, expiry)


def in_session(start_minute: int, end_minute: int, weekdays: list[int], ts: str = "ts") -> Column:
    """Whether a bar opens in [start, end) minutes of the day, on one of the weekdays (Monday is 0)."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute >= start_minute) & (minute < end_minute) & F.weekday(ts).isin(weekdays)
