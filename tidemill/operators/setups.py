"""Confirmed-hour context, market regimes and the setups that use both, as column expressions.

Rows are quarter-hour bars of continuous segments with the columns of ``with_indicators``; ``hour_regime`` adds ``h1_ts``,
``h1_close``, ``h1_fast``, ``h1_slow``, ``h1_slow_before`` and ``h1_atr`` of the last complete hour before each bar's own.
Setups add ``setup``, ``direction``, ``trigger``, ``stop`` and ``expiry``; a null input gives no signal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import body_share, close_location, div, span
from tidemill.operators.bars import bucket, complete
from tidemill.operators.indicators import with_indicators
from tidemill.operators.rolling import bars_since, previous_extremes, structural_stop

HOUR = {"h1_ts": "ts", "h1_close": "close", "h1_fast": "ema_fast", "h1_slow": "ema_slow", "h1_slow_before": "_before", "h1_atr": "atr"}


def hour_regime(rows: DataFrame, keys: list[str], fast: int = 50, slow: int = 200, atr: int = 14, lookback: int = 4, part: int = 900) -> DataFrame:
    """Adds the last complete hour's means and range; ``keys`` name series and segment. Hours with missing parts are
    skipped: means run on over complete hours, and ``h1_slow_before`` is the slow mean ``lookback`` complete hours ago."""
    base = rows.select(*keys, "ts", "open", "high", "low", "close", "volume")
    hours = with_indicators(complete(base, keys, 3600, part).select(base.columns), keys, fast, slow, atr)
    hours = hours.withColumn("_before", F.lag("ema_slow", lookback).over(Window.partitionBy(*keys).orderBy("ts")))
    seen = hours.select(*keys, (F.col("ts") + F.expr("interval 1 hour")).alias("_hour"), F.struct(*[F.col(c).alias(n) for n, c in HOUR.items()]).alias("_h1"))
    joined = rows.withColumn("_hour", bucket("ts", 3600)).join(seen, [*keys, "_hour"], "left")
    carried = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    found = joined.withColumn("_h1", F.last("_h1", ignorenulls=True).over(carried))
    return found.withColumns({n: F.col(f"_h1.{n}") for n in HOUR}).drop("_hour", "_h1")


def h1_slope() -> Column:
    return F.col("h1_slow") - F.col("h1_slow_before")


def h1_separation() -> Column:
    return F.when(F.col("h1_atr") > 0, F.abs(F.col("h1_fast") - F.col("h1_slow")) / F.col("h1_atr"))


def h1_bullish() -> Column:
    return (F.col("h1_close") > F.col("h1_slow")) & (F.col("h1_fast") > F.col("h1_slow")) & (h1_slope() > 0)


def h1_bearish() -> Column:
    return (F.col("h1_close") < F.col("h1_slow")) & (F.col("h1_fast") < F.col("h1_slow")) & (h1_slope() < 0)


def _sides() -> tuple[Column, Column]:
    """Whether hourly means, their slope and the quarter-hour means all point up, or all down."""
    up = (F.col("h1_fast") > F.col("h1_slow")) & (h1_slope() > 0) & (F.col("ema_fast") > F.col("ema_slow"))
    down = (F.col("h1_fast") < F.col("h1_slow")) & (h1_slope() < 0) & (F.col("ema_fast") < F.col("ema_slow"))
    return up, down


def classify_regime(trend_separation: float = 0.8, trend_adx: float = 18.0, range_separation: float = 0.8, range_adx: float = 20.0,
                    trend: bool = True, ranges: bool = True) -> Column:
    """TREND LONG, TREND SHORT, RANGE or CHOP (also while an input is null); a trend wins where both fit."""
    up, down = _sides()
    strong = F.lit(trend) & (h1_separation() >= trend_separation) & (F.col("adx") >= trend_adx)
    quiet = F.lit(ranges) & (h1_separation() <= range_separation) & (F.col("adx") <= range_adx)
    known = h1_separation().isNotNull() & h1_slope().isNotNull() & F.col("adx").isNotNull()
    return F.when(~known, "CHOP").when(strong & up, "TREND LONG").when(strong & down, "TREND SHORT").when(quiet, "RANGE").otherwise("CHOP")


def market_bucket(trend_separation: float = 1.0, adx: float = 18.0, range_separation: float = 0.8) -> Column:
    """WARMUP, BULLISH_TREND, BEARISH_TREND, NEUTRAL_RANGE or TRANSITION."""
    up, down = _sides()
    known = h1_separation().isNotNull() & h1_slope().isNotNull() & F.col("adx").isNotNull() & F.col("atr").isNotNull()
    strong = (h1_separation() >= trend_separation) & (F.col("adx") >= adx)
    return (
        F.when(~known, "WARMUP").when(strong & up, "BULLISH_TREND").when(strong & down, "BEARISH_TREND")
        .when(h1_separation() <= range_separation, "NEUTRAL_RANGE").otherwise("TRANSITION")
    )


def transition_reason(trend_separation: float = 1.0, adx: float = 18.0) -> Column:
    """Why a bar of TRANSITION is no trend: the first gate that it fails."""
    aligned = ((F.col("h1_fast") > F.col("h1_slow")) & (h1_slope() > 0)) | ((F.col("h1_fast") < F.col("h1_slow")) & (h1_slope() < 0))
    reason = F.when(h1_separation() < trend_separation, "EMERGING_SEPARATION").when(F.col("adx") < adx, "WIDE_BUT_WEAK_ADX")
    return F.when(market_bucket(trend_separation, adx) == "TRANSITION", reason.when(~aligned, "WIDE_BUT_H1_UNALIGNED").otherwise("WIDE_BUT_M15_OPPOSED"))


def alignment(lean: Column, stack: Column) -> Column:
    """ALIGNED, OPPOSED or NONE: a lean (BULLISH_LEAN, BEARISH_LEAN) against the sign of the quarter-hour means."""
    sign = F.when(lean == "BULLISH_LEAN", F.signum(stack)).when(lean == "BEARISH_LEAN", -F.signum(stack))
    return F.when(sign > 0, "ALIGNED").when(sign < 0, "OPPOSED").otherwise("NONE")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the setups."""

    adx: float = 18.0
    long_rsi: tuple[float, float] = (50.0, 75.0)
    short_rsi: tuple[float, float] = (25.0, 50.0)
    body: float = 0.5
    size: tuple[float, float] = (0.6, 2.75)
    extension: float = 2.5
    entry_buffer: float = 0.05
    stop_buffer: float = 0.2
    risk: tuple[float, float] = (0.6, 3.0)
    pending: int = 3
    longs: bool = True
    shorts: bool = True
    touch: int = 8
    location: float = 0.6
    tolerance: float = 0.2
    largest: float | None = None
    sweep: tuple[float, float] = (0.05, 0.8)
    sweep_body: float = 0.35
    sweep_rsi: float = 46.0
    separation: float = 0.8
    ranges: bool = True


BREAKOUT_SHORT = Rules(separation=1.0, body=0.7, size=(0.6, 2.0), longs=False, ranges=False)


def _signal(name: str, long: Column, short: Column, stops: tuple[Column, Column], r: Rules) -> Column:
    """A struct (setup, direction, trigger, stop, expiry), null without a signal; LONG is tested first, and a stop must lie
    within the risk band."""
    unit = F.col("atr")
    sides = []
    for side, test, on, trigger, stop in (("LONG", long, r.longs, F.col("high") + r.entry_buffer * unit, stops[0] - r.stop_buffer * unit),
                                          ("SHORT", short, r.shorts, F.col("low") - r.entry_buffer * unit, stops[1] + r.stop_buffer * unit)):
        risk = (trigger - stop) * (1 if side == "LONG" else -1)
        good = F.lit(on) & test & (unit > 0) & (trigger > 0) & (stop > 0) & (risk > 0) & div(risk, unit).between(*r.risk)
        made = F.struct(F.lit(name).alias("setup"), F.lit(side).alias("direction"), trigger.alias("trigger"), stop.alias("stop"), F.lit(r.pending).alias("expiry"))
        sides.append(F.when(F.coalesce(good, F.lit(False)), made))
    return F.coalesce(*sides)


def _with(rows: DataFrame, signal: Column) -> DataFrame:
    return rows.withColumn("_s", signal).select("*", "_s.*").drop("_s")


def _strong_bar(r: Rules, side: int, edge: Column) -> Column:
    """A strong candle in the direction ``side`` that closes beyond ``edge``, not too far from the fast mean."""
    move = (F.col("close") - F.col("open")) * side > 0
    near = div(F.abs(F.col("close") - F.col("ema_fast")), F.col("atr")) <= r.extension
    rsi = F.col("rsi").between(*(r.long_rsi if side > 0 else r.short_rsi))
    return move & rsi & near & (body_share() >= r.body) & div(span(), F.col("atr")).between(*r.size) & ((F.col("close") - edge) * side > 0)


def breakout_signal(r: Rules = Rules()) -> Column:
    """Breakout with the confirmed hour's trend; needs ``prev_high_5``, ``prev_low_5``, ``low_2`` and ``high_2``."""
    strength = F.col("adx") >= r.adx
    long = h1_bullish() & (F.col("ema_fast") > F.col("ema_slow")) & strength & _strong_bar(r, 1, F.col("prev_high_5"))
    short = h1_bearish() & (F.col("ema_fast") < F.col("ema_slow")) & strength & _strong_bar(r, -1, F.col("prev_low_5"))
    return _signal("breakout", long, short, (F.col("low_2"), F.col("high_2")), r)


def pullback_signal(r: Rules = Rules()) -> Column:
    """Rejection after a touch of the means, with the confirmed hour's trend; needs ``since_touch``: bars since a bar
    before this one touched a mean."""
    touched = F.col("since_touch") < r.touch
    small = F.lit(True) if r.largest is None else span() <= r.largest * F.col("atr")
    common = (F.col("adx") >= r.adx) & touched & small & (span() > 0)
    long = common & h1_bullish() & (F.col("ema_fast") > F.col("ema_slow")) & F.col("rsi").between(*r.long_rsi) & (F.col("close") > F.col("open"))
    long &= (close_location() >= r.location) & (F.col("low") >= F.col("ema_slow") - r.tolerance * F.col("atr"))
    short = common & h1_bearish() & (F.col("ema_fast") < F.col("ema_slow")) & F.col("rsi").between(*r.short_rsi) & (F.col("close") < F.col("open"))
    short &= (close_location() <= 1 - r.location) & (F.col("high") <= F.col("ema_slow") + r.tolerance * F.col("atr"))
    return _signal("pullback", long, short, (F.col("low"), F.col("high")), r)


def regime_signal(r: Rules = Rules()) -> Column:
    """Breakouts in a trend, sweeps of the last eight bars' extremes in a range; also needs ``prev_high_8`` and
    ``prev_low_8``."""
    state = classify_regime(r.separation, r.adx, ranges=r.ranges)
    trend = _signal("trend", (state == "TREND LONG") & _strong_bar(r, 1, F.col("prev_high_5")), (state == "TREND SHORT") & _strong_bar(r, -1, F.col("prev_low_5")), (F.col("low_2"), F.col("high_2")), r)
    unit, strong = F.col("atr"), body_share() >= r.sweep_body
    down, up = div(F.col("prev_low_8") - F.col("low"), unit), div(F.col("high") - F.col("prev_high_8"), unit)
    long = (state == "RANGE") & down.between(*r.sweep) & (F.col("close") > F.col("prev_low_8")) & (F.col("close") > F.col("open")) & strong & (F.col("rsi") <= r.sweep_rsi)
    short = (state == "RANGE") & up.between(*r.sweep) & (F.col("close") < F.col("prev_high_8")) & (F.col("close") < F.col("open")) & strong & (F.col("rsi") >= 100 - r.sweep_rsi)
    return F.coalesce(trend, _signal("range", long, short, (F.col("low"), F.col("high")), r))


def combined_signal(r: Rules = Rules()) -> Column:
    """Pullbacks before breakouts; of each, LONG before SHORT."""
    return F.coalesce(pullback_signal(r), breakout_signal(r))


SIGNALS = {"breakout": breakout_signal, "pullback": pullback_signal, "regime": regime_signal, "combined": combined_signal}


def prepared(rows: DataFrame, keys: list[str], lengths: tuple[int, ...] = (20, 50, 14, 14, 14), hours: tuple[int, ...] = (50, 200, 14, 4), part: int = 900) -> DataFrame:
    """All that the setups need, in one build: indicators, extremes, bars since a touch of the means, confirmed hours."""
    rows = with_indicators(rows, keys, *lengths)
    rows = structural_stop(previous_extremes(previous_extremes(rows, keys, 5), keys, 8), keys, 2)
    touch = F.col("low") <= F.greatest("ema_fast", "ema_slow")
    touch &= F.col("high") >= F.least("ema_fast", "ema_slow")
    return hour_regime(bars_since(rows, keys, touch, "since_touch"), keys, *hours, part=part)


def with_setup(rows: DataFrame, kind: str, rules: Rules = Rules()) -> DataFrame:
    """Adds the signal of a setup (a name of ``SIGNALS``) to prepared rows."""
    return _with(rows, SIGNALS[kind](rules))
