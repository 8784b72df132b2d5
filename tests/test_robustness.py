"""Composed path metrics against plain walks over paths, refusals, and resuming."""

import datetime as dt
import hashlib
import math
import pathlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import draws
from tidemill.operators import robustness as B

DAY = dt.datetime(2024, 1, 1)
TRADES = "trade_id long, fold long, role string, ts timestamp_ntz, r double"


def results(spark, values):
    return spark.createDataFrame([(i, DAY + dt.timedelta(hours=i), float(v)) for i, v in enumerate(values)], "n long, ts timestamp_ntz, r double")


def walked(path, fraction=0.01, level=None, drawdown=None):
    cum, peak, drop, lose, win, run, won = 0.0, -math.inf, 0.0, 0, 0, 0, 0
    equity, top, ruined = 1.0, 1.0, False
    for r in path:
        cum += r
        peak = max(peak, cum)
        drop = max(drop, peak - cum)
        run, won = run + 1 if r < 0 else 0, won + 1 if r > 0 else 0
        lose, win = max(lose, run), max(win, won)
        equity *= max(0.0, 1 + fraction * r)
        top = max(top, equity)
        ruined |= (level is not None and equity <= level) or (drawdown is not None and (top - equity) / top * 100 >= drawdown)
    return (round(cum, 9), round(drop, 9), lose, win, ruined if level is not None or drawdown is not None else None)


def number(seed, sim, place, most):
    return int(hashlib.md5(f"{seed}:{sim}:{place}".encode()).hexdigest()[:13], 16) % most


@pytest.mark.parametrize("n", [1, 7, 40])
@pytest.mark.parametrize("method,block", [(B.PERMUTATION, 1), (B.IID, 1), (B.BLOCK, 5), (B.BLOCK, 100)])
def test_paths_equal_plain_walks(spark, monkeypatch, n, method, block):
    monkeypatch.setattr(B, "FAN", 3)
    rng = random.Random(n)
    values = [rng.choice([-60.0, -1.0, 0.0, 0.5, 2.0, -100.0 if n == 7 else 1.0]) for _ in range(n)]
    for ruin in ({"ruin_level": 0.4}, {"ruin_drawdown": 60.0}, {}):
        found = B.paths(results(spark, values), method, 6, 3, block, **ruin).collect()
        kind = {"level": ruin.get("ruin_level"), "drawdown": ruin.get("ruin_drawdown")}
        want = []
        for sim in range(6):
            if method == B.PERMUTATION:
                path = [values[i] for i in sorted(range(n), key=lambda i, sim=sim: (number(3, sim, i, 1 << 52), i))]
            else:
                length = 1 if method == B.IID else min(block, n)
                starts = [number(3, sim, k, n - length + 1) for k in range(-(-n // length))]
                path = [values[s + i] for s in starts for i in range(length)][:n]
            want.append((sim, *walked(path, **kind)))
        assert sorted((r["sim"], round(r["terminal_r"], 9), round(r["max_drawdown_r"], 9), r["losing_streak"], r["winning_streak"], r["ruined"]) for r in found) == want


def test_blocks_across_chunks(spark):
    values = [((i * 7919) % 13) - 6 for i in range(9000)]
    found = {r["start"]: r["s"] for r in B.blocks(results(spark, values), 50, 9000, 0.01).collect()}
    assert sorted(found) == list(range(8951))
    for start in (0, 4046, 4047, 4090, 4095, 4096, 8190, 8950):
        total, drop, lose, win, _ = walked(values[start : start + 50])
        assert (found[start]["n"], found[start]["sum"], found[start]["drop"], found[start]["lose_most"], found[start]["win_most"]) == (50, total, drop, lose, win)


def test_known_list(spark):
    values = [1.0, 1.0, -1.0, -1.0, -1.0, 2.0, 0.5, -0.5, 3.0, -1.0]
    (r,) = B.observed(results(spark, values)).collect()
    assert (r["terminal_r"], r["max_drawdown_r"], r["losing_streak"], r["winning_streak"]) == (3.0, 3.0, 3, 2)
    tables = B.analysis(results(spark, values), B.PERMUTATION, threshold=3.0, simulations=20, ruin_level=0.5)
    assert {r["terminal_r"] for r in tables["paths"].collect()} == {3.0}
    (risk,) = tables["drawdown_risk"].collect()
    drops = sorted(r["max_drawdown_r"] for r in tables["paths"].collect())
    assert risk["observed"] == 3.0 and risk["breach_probability"] == sum(x >= 3 for x in drops) / 20 and risk["worst_5_percent_mean"] == drops[-1]
    assert {r["metric"] for r in tables["sequence_dependency"].collect()} == {"max_drawdown_r", "losing_streak"}
    assert {r["metric"]: r["minimum"] for r in tables["distributions"].collect()}["max_drawdown_r"] == drops[0]
    (ruin,) = tables["ruin"].collect()
    assert (ruin["risk_of_ruin"], ruin["positive_probability"]) == (0.0, 1.0)


def test_sources_are_refused_not_guessed(spark):
    rows = [(1, 1, "test", DAY, 1.0), (2, 1, "train", DAY, -5.0), (3, 2, "test", DAY - dt.timedelta(1), 2.0)]
    made = lambda *more: spark.createDataFrame([*rows, *more], TRADES)
    assert [(r["n"], r["r"]) for r in B.results_of_folds(made()).orderBy("n").collect()] == [(0, 2.0), (1, 1.0)]
    with pytest.raises(B.Blocked, match="overlap"):
        B.results_of_folds(made((1, 2, "test", DAY, 1.0)))
    for row, text in (((4, 1, "test", DAY, None), "no result"), ((4, 1, "test", None, 1.0), "no time")):
        with pytest.raises(B.Blocked, match=text):
            B.results_of_trades(made(row), exit_ts="ts", entry_ts="ts")
    with pytest.raises(B.Blocked, match="no trades"):
        B.results_of_trades(made().filter("false"), exit_ts="ts", entry_ts="ts")


def test_resuming(spark):
    a, b = (B.source_fingerprint(results(spark, v)) for v in ([1, 2], [2, 1]))
    assert a != b and a == B.source_fingerprint(results(spark, [1, 2]).repartition(2))
    run = {"source": a, "config": {"seed": 1}}
    assert B.resumable(run, a, {"seed": 1}) == run
    with pytest.raises(B.Blocked, match="source changed"):
        B.resumable(run, b, {"seed": 1})


@pytest.mark.parametrize("method,block", [(B.PERMUTATION, 1), (B.IID, 1), (B.BLOCK, 4), (B.BLOCK, 11)])
def test_paths_over_chunks_and_stretches(spark, monkeypatch, method, block):
    """Chunks of 7 to 11 results, stretches of a few draws from each; numbers of one to three digits."""
    monkeypatch.setattr(B, "CHUNK", 7)
    monkeypatch.setattr(B, "DRAWS", 3)
    rng, n = random.Random(5), 150
    values = [rng.choice([-3.0, -1.0, 0.0, 0.5, 2.0]) for _ in range(n)]
    for sim, *found in sorted(B.paths(results(spark, values), method, 11, 42, block, ruin_level=0.9).collect()):
        if method == B.PERMUTATION:
            path = [values[i] for i in sorted(range(n), key=lambda i, sim=sim: (number(42, sim, i, 1 << 52), i))]
        else:
            path = [values[number(42, sim, k, n - block + 1) + i] for k in range(-(-n // block)) for i in range(block)][:n]
        assert (round(found[0], 9), round(found[1], 9), *found[2:]) == walked(path, level=0.9)
    assert sim == 10
    (r,) = B.observed(results(spark, values)).collect()
    assert (r["terminal_r"], r["max_drawdown_r"], r["losing_streak"], r["winning_streak"]) == walked(values)[:4]


@pytest.mark.parametrize("method,block", [(B.PERMUTATION, 1), (B.IID, 1), (B.BLOCK, 4)])
def test_paths_shuffle_few_bytes_a_result(spark, method, block):
    """A result in a path costs about ten bytes of shuffle, not a row and a summary."""
    rng, n, sims = random.Random(1), 60000, 10
    rows = results(spark, [rng.random() - 0.5 for _ in range(n)]).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert len(B.paths(rows, method, sims, 1, block).collect()) == sims
    time.sleep(1)  # figures follow the tasks
    assert 0 < written() - before < 14 * n * sims


def test_numbers_are_md5s():
    for seed, sim, places in ((42, 0, range(1200)), (3, 99, (5, 9, 10, 99, 100, 999999999, 10**9, 10**10, 10**17)), (-(10**18), 10**18, (1, 10**15, 10**18))):
        assert draws.numbers(seed, sim, np.array(places)).tolist() == [number(seed, sim, p, 1 << 52) for p in places]


@pytest.mark.parametrize("method,block", [(B.PERMUTATION, 1), (B.IID, 1), (B.BLOCK, 4)])
def test_shuffles_of_paths_are_deleted_as_they_are_done(spark, monkeypatch, method, block):
    """Some paths at a time, the same ones, and nothing that was shuffled for them stays on disk."""
    rng, n, sims = random.Random(2), 60000, 20
    rows = results(spark, [rng.random() - 0.5 for _ in range(n)]).localCheckpoint()
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    disk = lambda: sum(p.stat().st_size for f in folders for p in pathlib.Path(f).rglob("shuffle_*.data") if p.exists())
    want = sorted(B.paths(rows, method, sims, 1, block, ruin_level=0.5).collect())
    monkeypatch.setattr(B, "AT_ONCE", 1)
    before, made, held = disk(), B._metrics, []
    monkeypatch.setattr(B, "_metrics", lambda *a: (time.sleep(1), held.append(disk() - before), made(*a))[2])
    assert sorted(B.paths(rows, method, sims, 1, block, ruin_level=0.5).collect()) == want
    time.sleep(1)  # they are deleted in the background
    assert len(held) == sims // B.LEAST and max(*held, disk() - before) < n * B.LEAST


def test_short_lists_have_few_stretches():
    """A stretch is a task's group, however short; it has about as many results as a chunk at least."""
    for length in (1, 5):
        size, chunks, stretch = B._cut(150_000, length)
        assert stretch % (length * chunks) == 0 and -(-150_000 // stretch) <= 3 and stretch <= 2 * size
    assert B._cut(9_000_000, 1) == (65536, 138, 1024 * 138)


@pytest.mark.parametrize("method", [B.IID, B.BLOCK])
def test_paths_of_a_short_list_take_few_tasks(spark, method):
    """A task draws some millions of results, not one stretch of one path."""
    rng, n = random.Random(3), 20000
    rows = results(spark, [rng.random() - 0.5 for _ in range(n)]).localCheckpoint()
    tasks = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalTasks()
    before = tasks()
    assert len(B.paths(rows, method, 90, 1, 4).collect()) == 90
    time.sleep(1)  # figures follow the tasks
    assert tasks() - before < 60


def test_trades_are_numbered_in_order_over_partitions(spark):
    rng, n = random.Random(4), 30000
    times = [rng.randrange(3000) for _ in range(n)]
    trades = spark.range(n).select(F.col("id").alias("trade_id"), F.timestamp_seconds(F.element_at(F.lit(times), F.col("id").cast("int") + 1)).alias("ts"), F.col("id").cast("double").alias("r")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = B.results_of_trades(trades, exit_ts="ts", entry_ts="ts").orderBy("n").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(range(n), key=lambda i: (times[i], i))
    assert [(x["n"], x["r"]) for x in found] == [(k, float(i)) for k, i in enumerate(want)]
