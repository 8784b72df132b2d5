"""Stateful streams: segments and an exponential mean carried from bar to bar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.carry import running

OUT = "symbol string, ts timestamp, close double, segment_id long, ema double"
STATE = "last_us long, segment_id long, ema double"


def stream_segments(bars: DataFrame, step: int = 900, n: int = 20) -> DataFrame:
    """For each bar of a stream (symbol, ts, close): its segment and the mean over the segment so far. A step other than
    ``step`` seconds begins a new segment and resets the mean; bars not later than the last one are dropped, so a bar
    that is read again after a restart changes nothing. The state of a symbol is three numbers."""
    k = 2 / (n + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, segment, mean = state.get if state.exists else (None, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, close in zip(rows["ts"], rows["close"], strict=True):
            at = int(ts.value // 1000)
            if last is not None and at <= last:
                continue
            if last is None or at - last != step * 1_000_000:
                segment, mean = segment + 1, float(close)
            else:
                mean += k * (close - mean)
            last = at
            out.append((key[0], ts, float(close), segment, mean))
        if last is not None:
            state.update((last, segment, mean))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "segment_id", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def deduplicated(bars: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (symbol, ts) once; state older than the watermark is dropped."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


ACCEPTED = "symbol string, ts timestamp, seq long, close double, status string, behind double"


def stream_in_order(rows: DataFrame) -> DataFrame:
    """Every row of a stream (symbol, ts, seq, close) with its ``status``: ACCEPTED, LATE (its time is before that of a row
    accepted earlier, by ``behind`` seconds), or REPEATED (it is not after the last row in sequence: read again). Refused
    rows come out beside the accepted ones, so nothing vanishes, and a sink can part them by ``status``. Rows of one
    micro-batch are taken by sequence, so how a stream is cut into micro-batches does not matter. A symbol's state is the last time
    and sequence; a restart from the checkpoint goes on from there."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        out = []
        for ts, seq, close in pd.concat(list(batches)).sort_values("seq", kind="stable")[["ts", "seq", "close"]].itertuples(index=False):
            at = int(ts.value // 1000)
            repeated = seen is not None and seq <= seen
            late = not repeated and last is not None and at < last
            if not repeated:
                seen, last = int(seq), at if last is None else max(last, at)
            out.append((key[0], ts, int(seq), float(close), "REPEATED" if repeated else "LATE" if late else "ACCEPTED", (last - at) / 1e6 if late else 0.0))
        if last is not None:
            state.update((last, seen))
        yield pd.DataFrame(out, columns=["symbol", "ts", "seq", "close", "status", "behind"])

    return rows.groupBy("symbol").applyInPandasWithState(update, ACCEPTED, "last_us long, seen long", "append", GroupStateTimeout.NoTimeout)


def table_in_order(rows: DataFrame, keys: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The same of a table whose ``seq`` is unique in its series: ``status`` (ACCEPTED or LATE) and ``behind``. Running
    maxima go by chunks of the sequence, so no task holds a series."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    chunks = rows.withColumn("_chunk", F.struct(*keys, F.floor(F.col(seq) / 65536).alias("_at")))
    before = running(chunks, keys, [seq], maxima={"_last": at}, before=True).drop("_chunk")
    late = F.coalesce(at < F.col("_last"), F.lit(False))
    return before.withColumns({"status": F.when(late, "LATE").otherwise("ACCEPTED"), "behind": F.when(late, (F.col("_last") - at) / 1e6).otherwise(0.0)}).drop("_last")
