"""Recursive indicators: each value depends on the one before, so a series (one key and segment) is one task's.

The recurrences are plain loops over the arrays of one batch, with the seeds stated below; what they carry passes from batch
to batch. Spark deals and sorts the series: one is a continuous segment, which ends at the first missing bar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ema(values: np.ndarray, n: int, held: dict | None = None) -> np.ndarray:
    """Exponential mean, seeded with the first value; ``held`` keeps what passes on to the next stretch of the series."""
    held = {} if held is None else held
    out, k = np.empty(len(values)), 2 / (n + 1)
    last = held.get("last")
    for i, v in enumerate(values.tolist()):
        last = v if last is None else last + k * (v - last)
        out[i] = last
    held["last"] = last
    return out


def rma(values: np.ndarray, n: int, held: dict | None = None) -> np.ndarray:
    """Wilder's mean of the values that are there: nan until ``n`` of them, then their mean, then the recurrence."""
    held = {} if held is None else held
    out = np.full(len(values), np.nan)
    seen, total, last = held.get("mean", (0, 0.0, None))
    for i, v in enumerate(values.tolist()):
        if v != v:
            continue
        if last is None:
            seen, total = seen + 1, total + v
            if seen == n:
                last = total / n
        else:
            last += (v - last) / n
        if last is not None:
            out[i] = last
    held["mean"] = (seen, total, last)
    return out


def ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray, before: float = np.nan) -> np.ndarray:
    """True range; the first bar's is high - low, unless the close ``before`` is given."""
    before = np.concatenate([np.full(min(1, len(close)), before), close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def rsi(close: np.ndarray, n: int, held: dict | None = None) -> np.ndarray:
    """Relative strength; 100 without losses, 50 without moves."""
    held = {} if held is None else held
    up, down = held.setdefault("up", {}), held.setdefault("down", {})
    move = np.concatenate([close[:1] - held.get("close", np.nan), np.diff(close)])
    gain, loss = rma(np.where(move == move, np.maximum(move, 0), np.nan), n, up), rma(np.where(move == move, np.maximum(-move, 0), np.nan), n, down)
    if len(close):
        held["close"] = close[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        found = 100 - 100 / (1 + gain / loss)
    return np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), found)


def dmi(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int, smooth: int, held: dict | None = None):
    """(+DI, -DI, ADX). The range mean takes the first bar too; the moves begin with the second."""
    held = {} if held is None else held
    means = [held.setdefault(c, {}) for c in ("spread", "plus", "minus", "adx")]
    begun = "bar" in held
    last = held.get("bar", (np.nan, np.nan, np.nan))
    first = np.full(min(1, len(high)), 1.0)
    up, down = np.diff(np.concatenate([first * last[0], high])), -np.diff(np.concatenate([first * last[1], low]))
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    if not begun:
        plus[:1] = minus[:1] = np.nan
    if len(high):
        held["bar"] = (high[-1], low[-1], close[-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = rma(ranges(high, low, close, last[2]), n, means[0])
        pos, neg = (np.where(spread > 0, 100 * rma(x, n, m) / spread, np.where(spread == 0, 0.0, np.nan)) for x, m in ((plus, means[1]), (minus, means[2])))
        dx = np.where(pos + neg > 0, 100 * np.abs(pos - neg) / (pos + neg), np.where(pos + neg == 0, 0.0, np.nan))
    return pos, neg, rma(dx, smooth, means[3])


def streamed(rows: DataFrame, keys: list[str], step: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """``step`` over each series in order of time, a batch at a time: it gets the rows and a dictionary that lasts for the
    series. A series of any length takes the memory of a batch in Python, and is sorted by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for pdf in batches:
            marks = list(map(tuple, pdf[keys].astype(object).where(pdf[keys].notna(), None).to_numpy()))
            starts = [i for i, k in enumerate(marks) if not i or k != marks[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(marks)], strict=True):
                if marks[lo] != now:
                    now, held = marks[lo], {}
                yield step(pdf.iloc[lo:hi], held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInPandas(run, schema)


def with_indicators(
    bars: DataFrame, keys: list[str], fast: int = 20, slow: int = 50, atr: int = 14, strength: int = 14, adx: int = 14
) -> DataFrame:
    """Adds ema_fast, ema_slow, atr, rsi, plus_di, minus_di and adx to bars of series without gaps (``keys`` include
    the segment). Null while an indicator is not seeded."""
    kept = bars.drop("ema_fast", "ema_slow", "atr", "rsi", "plus_di", "minus_di", "adx")
    names = ["ema_fast", "ema_slow", "atr", "rsi", "plus_di", "minus_di", "adx"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def step(pdf: pd.DataFrame, held: dict) -> pd.DataFrame:
        high, low, close = (pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        own = [held.setdefault(n, {}) for n in ("fast", "slow", "atr", "rsi", "dmi")]
        wide = ranges(high, low, close, held.get("close", np.nan))
        held["close"] = close[-1]
        found = [ema(close, fast, own[0]), ema(close, slow, own[1]), rma(wide, atr, own[2]), rsi(close, strength, own[3]), *dmi(high, low, close, adx, adx, own[4])]
        return pdf.assign(**dict(zip(names, found, strict=True)))

    found = streamed(kept, keys, step, f"{fields}, {', '.join(f'{n} double' for n in names)}")
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def smoothed(rows: DataFrame, keys: list[str], value: str, n: int, kind: str, name: str) -> DataFrame:
    """Adds one recursive mean (``ema`` or ``rma``) of a column."""
    kernel = {"ema": ema, "rma": rma}[kind]
    kept = rows.select(*keys, "ts", value)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)

    def step(pdf: pd.DataFrame, held: dict) -> pd.DataFrame:
        return pdf.assign(**{name: kernel(pdf[value].to_numpy(float), n, held)})

    found = streamed(kept, keys, step, f"{fields}, {name} double")
    return found.withColumn(name, F.when(~F.isnan(name), F.col(name)))
