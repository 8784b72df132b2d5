"""Resampled result paths of trade lists of any length.

The list is cut into chunks, and a path into stretches of places. What a path draws follows from a hash of (seed, path, place), so
any task can say it: a stretch asks each chunk for its results (two bytes a draw, and four that say where a block goes), the chunk
answers with them (eight bytes a result), and the stretch puts them in their places. In a permutation chunks send their results
unasked. A stretch then becomes one summary; summaries compose, as that of two stretches in a row follows from theirs. No task
holds a trade list or a path, nothing comes to the driver, and equal seeds give equal paths however rows are dealt. Paths are made
some at a time, and what was shuffled for them is deleted before the next ones.

Drawdowns here begin at the first trade's own result, as a path has no balance before it; those of equity begin at the
starting capital. Results without a value, or without a place in the order of time, are refused, not guessed."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import div
from tidemill.operators.carry import cumulative, percentiles
from tidemill.operators.draws import dealt, numbers, ranked, summary
from tidemill.operators.stored import stored
from tidemill.sources.stores import fingerprint

#: Summaries that are composed in one step.
FAN = 512
#: Results of a chunk at least, chunks at most (longer lists have larger chunks), and results that a stretch draws from a chunk on average.
CHUNK, CHUNKS, DRAWS = 65536, 1024, 1024
#: Results that are on disk at a time (about ten bytes each), but those of ``LEAST`` paths at least, and results of a task, as each task costs some time.
AT_ONCE, LEAST, SHARE = 1 << 27, 5, 6_000_000
PERMUTATION, IID, BLOCK = "PERMUTATION", "IID_BOOTSTRAP", "BLOCK_BOOTSTRAP"
METRICS = ("terminal_r", "max_drawdown_r", "losing_streak", "winning_streak")


class Blocked(ValueError):
    """An analysis that must not go on."""


# --- where results come from


def results_of_trades(trades: DataFrame, r: str = "r", exit_ts: str = "exit_ts", entry_ts: str = "entry_ts", trade_id: str = "trade_id") -> DataFrame:
    """Rows (n, ts, r) of a trade list, numbered from 0 by time of exit (or entry) and id. Refuses trades without a result or
    a time, and an empty list."""
    rows = trades.select(F.coalesce(exit_ts, entry_ts).alias("ts"), F.col(trade_id).alias("_id"), F.col(r).cast("double").alias("r"))
    found = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("r").isNull() | F.isnan("r"), 1)).alias("r"), F.count(F.when(F.col("ts").isNull(), 1)).alias("ts")).first()
    if not found["n"]:
        raise Blocked("no trades to analyse")
    if found["r"]:
        raise Blocked(f"{found['r']} trades have no result")
    if found["ts"]:
        raise Blocked(f"{found['ts']} trades have no time")
    return _in_order(rows.orderBy("ts", "_id").select("ts", "r"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Sorted rows (ts, r) with their numbers from 0, ``n``. Each batch of a partition is stored as one row, which is read and written
    faster than its rows; a table with a row for each batch carries how many rows come before."""

    def batched(batches):
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), column) for column in batch.columns]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(batch)], pa.int64()), *lists], ["part", "batch", "rows", "ts", "r"])

    kept = stored(rows.mapInArrow(batched, f"part int, batch int, rows long, ts array<{rows.schema['ts'].dataType.simpleString()}>, r array<double>"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part", "batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.select("part", "batch", "rows").select("part", "batch", before.alias("_start"))
    placed = kept.join(F.broadcast(starts), ["part", "batch"]).select("_start", F.posexplode(F.arrays_zip("ts", "r")).alias("_at", "_row"))
    return placed.select((F.col("_start") + F.col("_at")).alias("n"), "_row.ts", "_row.r")


def results_of_folds(trades: DataFrame, r: str = "r", ts: str = "ts", trade_id: str = "trade_id") -> DataFrame:
    """The same of a walk-forward's trades: those of the test windows (role ``test``) alone, in order of time. A trade that
    two folds hold is refused, as its windows overlap."""
    own = trades.filter("role = 'test'")
    twice = own.groupBy(trade_id).agg(F.count_distinct("fold").alias("folds")).filter("folds > 1").limit(1).count()
    if twice:
        raise Blocked("test windows overlap: a trade is in two folds")
    return results_of_trades(own, r, ts, ts, trade_id)


def source_fingerprint(results: DataFrame) -> str:
    """What identifies a list of results: their number and an order-free sum of their rows' hashes."""
    found = results.agg(F.count("*").alias("n"), F.sum(F.xxhash64("n", "ts", "r").cast("decimal(38,0)")).alias("h")).first()
    return fingerprint({"n": found["n"], "hash": str(found["h"])})


# --- summaries that compose


def _of_one(r: Column, fraction: float) -> Column:
    """The summary of a single result."""
    log = F.when(1 + fraction * r > 0, F.log(1 + fraction * r)).otherwise(F.lit(float("-inf")))
    lose, win = (r < 0).cast("long"), (r > 0).cast("long")
    zero = F.lit(0.0)
    return F.struct(
        F.lit(1).cast("long").alias("n"), r.alias("sum"), r.alias("high"), r.alias("low"), zero.alias("drop"),
        log.alias("log"), log.alias("log_high"), log.alias("log_low"), F.lit(0.0).alias("log_drop"),
        *[c.alias(f"{name}_{part}") for name, c in (("lose", lose), ("win", win)) for part in ("head", "tail", "most")],
    )


def composed(a: Column, b: Column) -> Column:
    """The summary of a stretch followed by another."""
    fields = [(a["n"] + b["n"]).alias("n")]
    for total, high, low, drop in (("sum", "high", "low", "drop"), ("log", "log_high", "log_low", "log_drop")):
        fields += [
            (a[total] + b[total]).alias(total), F.greatest(a[high], a[total] + b[high]).alias(high), F.least(a[low], a[total] + b[low]).alias(low),
            F.greatest(a[drop], b[drop], a[high] - (a[total] + b[low])).alias(drop),
        ]
    for name in ("lose", "win"):
        head, tail, most = (f"{name}_{p}" for p in ("head", "tail", "most"))
        fields += [
            F.when(a[head] == a["n"], a["n"] + b[head]).otherwise(a[head]).alias(head), F.when(b[tail] == b["n"], b["n"] + a[tail]).otherwise(b[tail]).alias(tail),
            F.greatest(a[most], b[most], a[tail] + b[head]).alias(most),
        ]
    return F.struct(*fields)


def folded(stretches: Column) -> Column:
    """The summary of an array of summaries in a row; null of an empty one."""
    rest = F.slice(stretches, 2, F.greatest(F.size(stretches) - 1, F.lit(0)))
    return F.when(F.size(stretches) > 0, F.aggregate(rest, F.element_at(stretches, 1), composed))


def reduced(rows: DataFrame, places: int) -> DataFrame:
    """One summary for each path of rows (sim, place, s), whose places are 0 to ``places`` - 1: groups of ``FAN`` in a row become
    one, again and again."""
    while places > 1:
        rows = rows.groupBy("sim", F.floor(F.col("place") / FAN).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("_l"))
        rows = rows.select("sim", F.col("_g").alias("place"), folded(F.transform("_l", lambda x: x["s"])).alias("s"))
        places = -(-places // FAN)
    return rows.select("sim", "s")


def blocks(results: DataFrame, length: int, total: int, fraction: float) -> DataFrame:
    """The summary of every block of ``length`` results in a row: rows (start, s). Places are dealt to chunks with an overlap,
    so no window runs over the whole list."""
    own = results.select("n", _of_one(F.col("r"), fraction).alias("s"))
    if length == 1:
        return own.select(F.col("n").alias("start"), "s")
    size = max(4096, length)
    chunk = F.floor(F.col("n") / size)
    dealt = own.withColumn("_c", F.explode(F.when((F.col("n") % size < length - 1) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy("_c").orderBy("n").rowsBetween(0, length - 1)
    rows = dealt.withColumn("_l", F.collect_list("s").over(w)).filter((chunk == F.col("_c")) & (F.col("n") <= total - length))
    return rows.select(F.col("n").alias("start"), folded(F.col("_l")).alias("s"))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in an array, from its start to each of ``ends``, in bytes."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _items(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """What the binary values of a column hold, one after another, and where each ends, in items."""
    column, width = column.cast(pa.binary()), np.dtype(kind).itemsize
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    ends = (offsets[1:] - offsets[0]) // width
    return np.frombuffer(column.buffers()[2], kind, ends[-1], offsets[0]) if ends[-1] else np.empty(0, kind), ends


def _all_items(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[_items(x, kind)[0] for x in table.column(name).chunks]])


def packed(results: DataFrame, size: int, more: int = 0) -> DataFrame:
    """Rows (chunk, r): ``size`` results in a row as doubles, and the next ``more`` (fewer than ``size``) after them."""

    def pieces(batches):
        for batch in batches:
            n, r = batch.column("n").to_numpy(), batch.column("r").to_numpy()
            chunk = n // size
            guest = (n % size < more) & (chunk > 0)
            chunk, n, r = np.append(chunk, chunk[guest] - 1), np.append(n, n[guest]), np.append(r, r[guest])
            order = np.argsort(chunk, kind="stable")
            chunk, at, r = chunk[order], (n[order] - chunk[order] * size).astype(np.uint32), r[order]
            ends = np.append(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)) if len(chunk) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(chunk[ends - 1], pa.int64()), _binary(at, 4 * ends), _binary(r, 8 * ends)], ["chunk", "at", "r"])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(_all_items(table, "at", np.uint32))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "r": pa.array([_all_items(table, "r", np.float64)[order].tobytes()], pa.binary())})

    found = results.select(F.col("n").cast("long").alias("n"), F.col("r").cast("double").alias("r")).mapInArrow(pieces, "chunk long, at binary, r binary")
    return found.groupBy("chunk").applyInArrow(pack, "chunk long, r binary")


def _cut(total: int, length: int) -> tuple[int, int, int]:
    """Results of a chunk, chunks, and results of a stretch of a path, of which a chunk gives about ``DRAWS`` (more where chunks are few,
    as a stretch is not much shorter than a chunk)."""
    size = max(CHUNK, length, -(-total // CHUNKS))
    chunks = -(-total // size)
    return size, chunks, max(1, DRAWS // length, CHUNK // length // chunks) * length * chunks


_SUMMARY = ", ".join(["n long"] + [f"`{c}` double" for c in ("sum", "high", "low", "drop", "log", "log_high", "log_low", "log_drop")] + [f"{name}_{part} long" for name in ("lose", "win") for part in ("head", "tail", "most")])
_SENT, _DRAWN = "sim long, place long, chunk long, data binary", "sim long, place long, chunk long, data binary, at binary"


def _tasks(results: int, most: int) -> int:
    """How many tasks see to so many results, one for each ``SHARE``. Spark's own choice is a few more than there are cores, which
    then wait for a second round."""
    return max(1, min(most, -(-results // SHARE)))


def _summarised(rows: DataFrame, results_of, fraction: float, tasks: int) -> DataFrame:
    """Rows (sim, place, s) of what the chunks sent for a stretch, put in the order of its places by ``results_of``."""

    def follow(table: pa.Table) -> pa.Table:
        sim, place = table.column("sim")[0].as_py(), table.column("place")[0].as_py()
        found = {"sim": sim, "place": place, **summary(results_of(sim, place, table), fraction)}
        return pa.table({name: [value] for name, value in found.items()})

    found = rows.repartition(tasks, "sim", "place").groupBy("sim", "place").applyInArrow(follow, f"sim long, place long, {_SUMMARY}")
    return found.select("sim", "place", F.struct(*[c for c in found.columns if c not in ("sim", "place")]).alias("s"))


def _permuted(lists: DataFrame, total: int, sims: range, seed: int, fraction: float) -> tuple[DataFrame, int]:
    """Summaries of stretches of permutations, and how many a path has. Each chunk deals its results to stretches by their numbers
    drawn, and sends where they lie and what they are; the stretch draws the numbers again and sorts."""
    size, chunks, stretch = _cut(total, 1)
    stretches, kind = -(-total // stretch), np.uint16 if size <= 1 << 16 else np.uint32

    def send(batches):
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"].tolist(), pdf["r"], strict=True):
                r = np.frombuffer(data)
                for sim in sims:
                    upper = numbers(seed, sim, np.arange(chunk * size, chunk * size + len(r))) >> np.uint64(20)
                    order, parts = dealt((upper * np.uint64(stretches) >> np.uint64(32)).astype(np.int64), stretches)
                    at, own = order.astype(kind), r[order]
                    yield pd.DataFrame({"sim": sim, "place": [k for k, _, _ in parts], "chunk": chunk, "data": [at[a:b].tobytes() + own[a:b].tobytes() for _, a, b in parts]})

    def sorted_results(sim, place, table):
        pdf = table.to_pandas().sort_values("chunk")
        each = [len(data) // (8 + kind().nbytes) for data in pdf["data"]]
        n = np.concatenate([chunk * size + np.frombuffer(data, kind, k).astype(np.int64) for chunk, data, k in zip(pdf["chunk"].tolist(), pdf["data"], each, strict=True)])
        r = np.concatenate([np.frombuffer(data[k * kind().nbytes :]) for data, k in zip(pdf["data"], each, strict=True)])
        return r[ranked(numbers(seed, sim, n))]  # of equal numbers the earlier result comes first

    return _summarised(lists.mapInPandas(send, _SENT), sorted_results, fraction, _tasks(len(sims) * total, len(sims) * stretches)), stretches


def _drawn(lists: DataFrame, total: int, length: int, sims: range, seed: int, fraction: float) -> tuple[DataFrame, int]:
    """Summaries of stretches of paths drawn in blocks, and how many a path has."""
    size, chunks, stretch = _cut(total, length)
    places, each, kind = -(-total // length), stretch // length, np.uint16 if size <= 1 << 16 else np.uint32
    stretches = -(-places // each)

    def starts(sim, place):
        found = numbers(seed, sim, np.arange(place * each, min(places, (place + 1) * each))) % np.uint64(total - length + 1)
        return found.astype(np.int64)

    def ask(batches):
        for batch in batches:
            for sim, place in zip(batch.column("sim").to_pylist(), batch.column("place").to_pylist(), strict=True):
                start = starts(sim, place)
                order, parts = dealt(start // size, chunks)
                of, ends = np.array([k for k, _, _ in parts]), np.array([b for _, _, b in parts])
                at, same = (start % size).astype(kind)[order], [pa.array(np.full(len(of), x)) for x in (sim, place)]
                own = _binary(order.astype(np.uint32), 4 * ends) if length > 1 else pa.nulls(len(of), pa.binary())
                yield pa.record_batch([*same, pa.array(of), _binary(at, at.itemsize * ends), own], ["sim", "place", "chunk", "data", "at"])

    def answer(batches):
        windows = None
        for batch in batches:
            cuts = sorted({*np.flatnonzero(batch.column("sim").to_numpy() < 0).tolist(), *range(0, len(batch), 256), len(batch)})  # answers are larger than questions
            for lo, hi in itertools.pairwise(cuts):
                if batch.column("sim")[lo].as_py() < 0:  # the chunk itself comes before what is asked of it
                    r, lo = np.frombuffer(batch.column("data")[lo].as_py()), lo + 1
                    windows = np.lib.stride_tricks.sliding_window_view(r, min(length, len(r)))  # in a shorter chunk, the last, no block begins
                part = batch.slice(lo, hi - lo)
                if len(part):
                    asked, ends = _items(part.column("data"), kind)
                    yield part.set_column(3, "data", _binary(windows[asked], 8 * length * ends))

    def placed(sim, place, table):
        if length > 1:
            at = _all_items(table, "at", np.uint32)
        else:  # the place of each result would be half as long as itself, so it is found again
            table = table.sort_by("chunk")
            at, _ = dealt(starts(sim, place) // size, chunks)
        path = np.empty((len(at), length))
        path[at] = _all_items(table, "data", np.float64).reshape(-1, length)
        return path.ravel()[: total - place * stretch]  # the last block is cut

    results = len(sims) * total
    ids = lists.sparkSession.range(sims.start * stretches, sims.stop * stretches, 1, _tasks(results, len(sims) * stretches))
    asked = ids.select(F.floor(F.col("id") / stretches).alias("sim"), (F.col("id") % stretches).alias("place")).mapInArrow(ask, _DRAWN)
    both = asked.unionByName(lists.select(F.lit(-1).cast("long").alias("sim"), F.lit(-1).cast("long").alias("place"), "chunk", F.col("r").alias("data"), F.lit(None).cast("binary").alias("at")))
    dealt_out = both.repartition(_tasks(results, chunks), "chunk").sortWithinPartitions("chunk", "sim", "place")
    return _summarised(dealt_out.mapInArrow(answer, _DRAWN), placed, fraction, _tasks(results, len(sims) * stretches)), stretches


def paths(
    results: DataFrame, method: str = BLOCK, simulations: int = 5000, seed: int = 42, block: int = 5, fraction: float = 0.01, ruin_level: float | None = None,
    ruin_drawdown: float | None = None,
) -> DataFrame:
    """Metrics of ``simulations`` resampled paths, as long as the list: its results in another order (PERMUTATION), drawn one
    by one (IID), or drawn in blocks, of which the last is cut (BLOCK; a block is at most the list). ``ruined`` is whether
    equity, which risks ``fraction`` of itself a trade, falls to ``ruin_level`` of the start, or by ``ruin_drawdown`` percent
    from its peak (the start included); null without either."""
    if simulations <= 0 or block <= 0 or not 0 < fraction < 1:
        raise ValueError("simulations and block must be positive, the risked fraction between 0 and 1")
    total = results.count()
    if not total:
        raise Blocked("no trades to analyse")
    length = min(block, total) if method == BLOCK else 1
    size, chunks, _ = _cut(total, length)
    lists = stored(packed(results, size, length - 1).repartitionByRange(_tasks(total, chunks), "chunk"))
    found, step = [], max(LEAST, AT_ONCE // total)
    for first in range(0, simulations, step):
        sims = range(first, min(first + step, simulations))
        rows, stretches = _permuted(lists, total, sims, seed, fraction) if method == PERMUTATION else _drawn(lists, total, length, sims, seed, fraction)
        found.append(stored(_metrics(reduced(rows, stretches), ruin_level, ruin_drawdown)))
    return functools.reduce(DataFrame.unionByName, found)


def _metrics(rows: DataFrame, ruin_level: float | None, ruin_drawdown: float | None) -> DataFrame:
    s = F.col("s")
    if ruin_level is not None:
        ruined = s["log_low"] <= math.log(ruin_level)
    elif ruin_drawdown is not None:
        ruined = F.greatest(s["log_drop"], -s["log_low"]) >= -math.log(1 - ruin_drawdown / 100)
    else:
        ruined = F.lit(None).cast("boolean")
    return rows.select("sim", s["sum"].alias("terminal_r"), s["drop"].alias("max_drawdown_r"), s["lose_most"].alias("losing_streak"), s["win_most"].alias("winning_streak"), ruined.alias("ruined"))


def observed(results: DataFrame, fraction: float = 0.01, ruin_level: float | None = None, ruin_drawdown: float | None = None) -> DataFrame:
    """The same metrics of the list as it is, one row."""
    total = results.count()
    size, chunks, _ = _cut(total, 1)
    sent = packed(results, size).select(F.lit(0).cast("long").alias("sim"), F.col("chunk").alias("place"), "chunk", F.col("r").alias("data"))
    rows = _summarised(sent, lambda sim, place, table: _all_items(table, "data", np.float64), fraction, _tasks(total, chunks))
    return stored(_metrics(reduced(rows, chunks), ruin_level, ruin_drawdown).drop("sim"))


# --- what paths say


def distributions(found: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Least, percentiles, greatest and mean of each metric over paths, a row for each; exact, without a list in one place."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    rows = found.select(stacked.alias("_s")).select("_s.*")
    shares = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    ends = rows.groupBy("metric").agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"))
    return percentiles(rows, ["metric"], F.col("value"), shares).drop("n").join(ends, "metric")


def worst_mean(found: DataFrame, metric: str, percent: float = 5.0) -> DataFrame:
    """One row: the mean of the greatest ``percent`` per cent of a metric's values, at least one."""
    rows = cumulative(found.withColumn("_all", F.lit(0)), ["_all"], F.col(metric))
    k = F.greatest(F.lit(1), F.ceil(F.col("total") * percent / 100))
    above = F.col("total") - F.col("below") - F.col("n")
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - above))
    return rows.agg(div(F.sum(F.col("value") * taken), F.sum(taken)).alias("worst_mean"))


def drawdown_risk(found: DataFrame, seen: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: the observed greatest drawdown, its place among the paths' (percent at or below it), their percentiles, the
    mean of their worst 5 percent, and how many reach the threshold."""
    own = seen.select(F.col("max_drawdown_r").alias("observed"))
    breach = F.avg((F.col("max_drawdown_r") >= threshold).cast("double")) if threshold is not None else F.lit(None).cast("double")
    place = found.crossJoin(own).agg(F.avg((F.col("max_drawdown_r") <= F.col("observed")).cast("double") * 100).alias("observed_percentile"), breach.alias("breach_probability"))
    spread = distributions(found, ("max_drawdown_r",)).select("median", "p90", "p95", "p99")
    return own.crossJoin(place).crossJoin(spread).crossJoin(worst_mean(found, "max_drawdown_r").withColumnRenamed("worst_mean", "worst_5_percent_mean"))


def sequence_dependency(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Where the observed path lies among permutations, a row for each metric that the order of trades decides, with a warning
    where its drawdown is among the outer 5 percent."""
    metrics = ("max_drawdown_r", "losing_streak")
    own = seen.select(*[F.col(m).alias(f"_{m}") for m in metrics])
    rows = found.crossJoin(own).agg(*[F.struct(F.lit(m).alias("metric"), F.max(F.col(f"_{m}").cast("double")).alias("observed"), F.avg((F.col(m) <= F.col(f"_{m}")).cast("double") * 100).alias("percentile")).alias(m) for m in metrics])
    rows = rows.select(F.explode(F.array(*metrics)).alias("_s")).select("_s.*")
    drop = F.col("metric") == "max_drawdown_r"
    return rows.withColumn("warning", F.when(drop & (F.col("percentile") >= 95), "UNUSUALLY SEVERE CLUSTERING").when(drop & (F.col("percentile") <= 5), "LOWER THAN TYPICAL DRAWDOWN"))


def iid_against_block(iid: DataFrame, block: DataFrame) -> DataFrame:
    """Distributions of both ways to draw, side by side, a row for each metric and way."""
    a, b = (distributions(df).withColumn("method", F.lit(name)) for df, name in ((iid, IID), (block, BLOCK)))
    return a.unionByName(b)


def analysis(results: DataFrame, method: str = BLOCK, threshold: float | None = None, **how) -> dict[str, DataFrame]:
    """Paths and all that is said about them; sequence dependency for permutations alone."""
    ruin = {k: v for k, v in how.items() if k in ("fraction", "ruin_level", "ruin_drawdown")}
    found, seen = paths(results, method, **how), observed(results, **ruin)
    tables = {"paths": found, "observed": seen, "distributions": distributions(found), "drawdown_risk": drawdown_risk(found, seen, threshold)}
    tables["ruin"] = found.agg(F.avg(F.col("ruined").cast("double")).alias("risk_of_ruin"), F.avg((F.col("terminal_r") > 0).cast("double")).alias("positive_probability"))
    return tables | ({"sequence_dependency": sequence_dependency(found, seen)} if method == PERMUTATION else {})


def resumable(stored: dict, source: str, config: dict) -> dict:
    """The stored run, if it was of these results and this configuration; else the analysis is blocked."""
    changed = [n for n, v in {"source": source, "config": config}.items() if stored.get(n) != v]
    if changed:
        raise Blocked("resume blocked: " + ", ".join(f"{n} changed" for n in changed))
    return stored
