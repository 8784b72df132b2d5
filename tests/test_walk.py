"""Neighbourhoods, folds, selection, structural events against a plain state machine, pairing, fills."""

import datetime as dt
import itertools
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from tidemill.operators import events as E
from tidemill.operators import search as V
from tidemill.operators import walk as W
from tidemill.operators.carry import with_overlap

START = dt.datetime(2020, 1, 1)
METRICS = "total_trades int, profit_factor double, average_r double, pnl double, max_drawdown double"


def rated(spark, rows):
    return spark.createDataFrame([("g", f"{a}|{b}", float(a), float(b), *m) for a, b, *m in rows], f"g string, candidate string, a double, b double, {METRICS}")


def test_stability_equals_brute_force(spark):
    rng = random.Random(3)
    grid = [c for c in itertools.product((1, 2, 3, 4), (1, 2, 3)) if rng.random() < 0.8]
    rows = [(a, b, 5, rng.choice([None, 1.0, 3.0, 0.5]), rng.choice([None, -0.1, 0.2]), rng.choice([-1.0, 2.0]), rng.choice([0.0, 5.0])) for a, b in grid]
    found = {r["candidate"]: r for r in W.stability(rated(spark, rows), {"a": (1, 4), "b": (1, 3)}, ["g"]).collect()}
    assert len(found) == len(rows)
    for a, b, _, _, _, _, _ in rows:
        near = [r for r in rows if (r[0] != a) + (r[1] != b) == 1]
        got = found[f"{a}|{b}"]
        assert got["neighbors"] == len(near)
        if near:
            assert got["profitable_percent"] == pytest.approx(100 * sum(r[5] > 0 for r in near) / len(near))
            assert got["positive_r_percent"] == pytest.approx(100 * sum((r[4] or 0) > 0 for r in near) / len(near))
        assert (W.BOUNDARY in got["warnings"]) == (a in (1, 4) or b in (1, 3))
    alone = W.stability(rated(spark, [(2, 2, 5, 1.0, 1.0, 1.0, 0.0)]), {"a": (1, 4), "b": (1, 3)}, ["g"]).first()
    assert (alone["neighbors"], alone["classification"], alone["stability_score"], alone["warnings"]) == (0, W.CLASSES[3], None, [])


def test_policy(spark):
    rows = rated(spark, [(1, 1, 2, 2.0, 1.0, 1.0, 5.0), (1, 2, 9, None, 1.0, 1.0, 5.0), (1, 3, 9, 2.0, -1.0, 1.0, 0.0), (2, 1, 9, 2.0, 0.0, 1.0, 4.0)])
    policy = W.Policy(minimum_trades=3, maximum_drawdown=4.5, minimum_profit_factor=1.0)
    found = {r["candidate"]: r["why"] for r in rows.withColumn("why", policy.refusal()).collect()}
    assert found == {"1|1": "trades<3; max_dd>4.5", "1|2": "max_dd>4.5; pf<1.0", "1|3": "max_dd>4.5; average_r<0.0", "2|1": None}


def test_isolated_candidate_gives_way(spark):
    rows = rated(spark, [(1, 1, 9, 9.0, 9.0, 1.0, 1.0), (1, 2, 9, 2.0, 1.0, 1.0, 1.0)])
    rows = rows.withColumns({
        "stability_score": F.lit(1.0), "median_r": F.lit(1.0), "classification": F.lit(W.CLASSES[0]),
        "warnings": F.when(F.col("b") == 1, F.array(F.lit(W.ISOLATED))).otherwise(F.array().cast("array<string>")),
    })
    assert W.select(rows, ["g"]).first()["candidate"] == "1|2"
    assert W.select(rows.filter("b = 1"), ["g"]).first()["candidate"] == "1|1"
    assert W.select(rows, ["g"], W.Policy(avoid_isolated=False)).first()["candidate"] == "1|1"
    assert W.select(rows, ["g"], W.Policy(minimum_trades=99)).count() == 0


def test_walk_forward(spark):
    """Of two with equal scores the one with the better neighbour is chosen (its own result comes later in the order) and judged
    in test. In fold 1 training has losses, and the neighbour with the smaller drawdown gives the higher score. A fold in which
    all lose has no selection."""
    days = [START + dt.timedelta(days=i) for i in range(0, 360, 3)]
    gain = lambda a, day: (1.0 if day < START + dt.timedelta(days=150) else -1.0) * (10.0 if a == 2 else 1.0)
    rows = [(f"{a}|1", float(a), 1.0, day, i, gain(a, day) + (i % 2) * 0.25, gain(a, day) / 10) for a in (1, 2) for i, day in enumerate(days)]
    trades = spark.createDataFrame(rows, "candidate string, a double, b double, ts timestamp_ntz, trade_id int, pnl double, r double")
    folds = V.folds(spark, "2020-01-01", "2020-12-01", 3, 2)
    found = W.walk_forward(trades, trades.select("candidate", "a", "b").distinct(), folds, {"a": (1, 2), "b": (1, 1)}, ["ts", "trade_id"]).orderBy("fold").collect()
    assert [(r["fold"], r["status"], r["candidate"]) for r in found] == [(0, "SELECTED", "1|1"), (1, "SELECTED", "2|1"), (2, "NO_SELECTION", None), (3, "NO_SELECTION", None)]
    assert found[0]["total_trades"] == sum(d < dt.datetime(2020, 4, 1) for d in days)
    inside = [r for r in rows if r[0] == "1|1" and dt.datetime(2020, 4, 1) <= r[3] < dt.datetime(2020, 6, 1)]
    assert (found[0]["test_total_trades"], found[0]["test_pnl"]) == (len(inside), pytest.approx(sum(r[5] for r in inside)))
    again = spark.createDataFrame([(0, "SELECTED", 1.0), (1, "NO_SELECTION", None), (2, "SELECTED", 4.0), (3, "SELECTED", 2.0)], "fold int, status string, a double")
    assert tuple(W.selected_drift(again, ["a"]).first()) == ("a", 3, True, 5.0)


def test_fold_bars(spark):
    bars = spark.createDataFrame([("s", START + dt.timedelta(days=i)) for i in range(122)], "symbol string, ts timestamp_ntz")
    used = W.fold_bars(bars, V.folds(spark, "2020-01-01", "2020-05-01", 2, 1), ["symbol"], 4, 7)
    first = {r["use"]: r["count"] for r in used.filter("fold = 0").groupBy("use").count().collect()}
    assert first == {"train": 53, "warmup": 7, "embargo": 4, "eligible": 27}
    row = W.fold_integrity(used, ["symbol"], 60, 31).filter("fold = 0").first()
    assert (row["training_end"], row["warmup_start"], row["validation_start"], row["fault"]) == (dt.datetime(2020, 2, 29), dt.datetime(2020, 2, 23), dt.datetime(2020, 3, 5), None)
    faults = W.fold_integrity(used, ["symbol"], 61, 31).filter("fold = 0").first()["fault"]
    assert faults == "has 60 training bars, requires 61"
    late = W.fold_bars(bars, V.folds(spark, "2020-01-01", "2020-05-01", 2, 1), ["symbol"], 40, 7)
    assert W.fold_integrity(late, ["symbol"], 1, 1).filter("fold = 0").first()["fault"] == W.EMPTY_FAULT


def plain_events(rows):
    """A state machine over the bars in order, for breaks, retests and reclaims."""
    state = {s: [None, 0, False] for s in (0, 1)}
    was, out = {0: None, 1: None}, []
    for i, (o, h, lo, c, atr) in enumerate(rows):
        prior = rows[i - 20 : i] if i >= 20 else None
        levels = (max(r[1] for r in prior), min(r[2] for r in prior)) if prior else (None, None)
        beyond = (lambda a, b: a > b, lambda a, b: a < b)
        got = []
        for s in (0, 1):
            broke = levels[s] is not None and beyond[s](c, levels[s])
            if was[s] is not None and beyond[s](was[s], c):
                got.append(E.FAILED[s])
            if broke:
                got.append(E.BREAK[s])
            level, age, tested = state[s]
            if level is not None and atr:
                if not tested and (lo <= level + 0.1 * atr if s == 0 else h >= level - 0.1 * atr):
                    state[s][2] = True
                    got.append(E.RETEST[s])
                elif tested and beyond[s](c, o) and beyond[s](c, level):
                    state[s][0] = None
                    got.append(E.RECLAIM[s])
            was[s] = levels[s] if broke else None
            if broke:
                state[s] = [levels[s], 0, False]
            elif state[s][0] is not None:
                state[s][1] += 1
                if state[s][1] > 5:
                    state[s][0] = None
        out.append(sorted(got))
    return out


def test_bar_events_equal_a_state_machine(spark, monkeypatch):
    rng = random.Random(11)
    rows, price = [], 100.0
    for _ in range(1500):
        o, price = price, price + rng.gauss(0, 1)
        rows.append((o, max(o, price) + rng.random() * 0.5, min(o, price) - rng.random() * 0.5, price, rng.choice([1.0, 1.0, 1.0, 0.0, None])))
    bars = spark.createDataFrame(
        [("s", START + dt.timedelta(hours=i), *r, r[0], r[3]) for i, r in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, atr double, fast double, slow double"
    )
    chain = {*E.BREAK, *E.FAILED, *E.RETEST, *E.RECLAIM}
    want = plain_events(rows)
    assert {x for e in want for x in e} == chain
    for size in (65536, 50):  # one block, and many that overlap
        monkeypatch.setattr(E, "with_overlap", lambda df, number, n, size=size: with_overlap(df, number, n, size))
        got = [sorted(set(r["events"]) & chain) for r in E.bar_events(bars, ["symbol"]).orderBy("ts").collect()]
        assert got == want


def test_whole_trades(spark):
    log = [(1, None, 10), (2, 20, None), (3, 30, 30), (4, None, 40), (5, 50, None), (6, 60, None), (7, None, 70)]
    rows = spark.createDataFrame([("s", *r) for r in log], "symbol string, n int, entry int, leave int")
    found = E.whole_trades(rows, ["symbol"], ["n"], ["entry"], ["leave"]).orderBy("trade").collect()
    assert [tuple(r)[1:] for r in found] == [(0, None, None, 1), (1, 20, None, 0), (2, 30, 30, 1), (3, 50, None, 0), (4, 60, 70, 0)]


def test_fills(spark):
    schema = "client_tag string, action string, requested_price double, filled_price double, requested_sl double, broker_sl double, requested_tp double, broker_tp double, requested_volume double, filled_volume double, commission double, swap double"
    rows = [
        ("a", "SUBMIT", 10.0, 10.5, 9.0, 9.0, 12.0, None, 1.0, 0.5, 0.1, None), ("a", "MODIFY", None, None, None, None, None, None, None, None, 9.0, None),
        ("b", "SUBMIT", 10.0, 9.0, 9.0, 9.5, 12.0, 12.0, 1.0, 1.0, 0.2, 0.3), ("c", "SUBMIT", 10.0, None, None, None, None, None, 1.0, 0.0, None, None),
        ("d", "MODIFY", None, None, None, None, None, None, None, None, None, None), ("d", "MODIFY", None, None, None, None, None, None, None, None, None, None),
    ]
    got = E.fill_summary(spark.createDataFrame(rows, schema)).first().asDict()
    assert {k: got[k] for k in ("submissions", "partial_fills", "sl_mismatches", "tp_mismatches", "slippages", "slippage_worst", "duplicate_tags", "clean")} == {
        "submissions": 3, "partial_fills": 1, "sl_mismatches": 1, "tp_mismatches": 0, "slippages": 2, "slippage_worst": -1.0, "duplicate_tags": 1, "clean": False,
    }
    assert got["slippage_mean"] == pytest.approx(-0.25) and got["commission_total"] == pytest.approx(0.3)
    empty = E.fill_summary(spark.createDataFrame([], schema)).first()
    assert (empty["submissions"], empty["slippage_worst"], empty["clean"]) == (0, None, True)


def test_resampling(spark):
    paths = V.bootstrap(spark, [1.0, 2.0, 4.0], 200, block=3, circular=True).toPandas()
    assert set(paths["terminal_r"]) == {7.0}  # a whole turn, wherever it begins
    values = {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0]}
    some = [r["candidate"] for r in V.random_grid(spark, values, 4, 7).collect()]
    assert len(set(some)) == 4 and sorted(some) == sorted(r["candidate"] for r in V.random_grid(spark, values, 4, 7).collect())
    assert V.random_grid(spark, values, 99, 7).count() == 6


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_neighbours_at_a_distance_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    places = sorted({(rng.choice([1.0, 2.0, 4.5]), rng.choice([0.1, 0.7]), rng.choice([3.0, 9.0, 20.0])) for _ in range(14)})
    rows = [(f"c{i}", *p, 10 + i, rng.uniform(0.5, 2), rng.uniform(-1, 1), rng.uniform(-50, 50), rng.uniform(0, 30)) for i, p in enumerate(places)]
    schema = "candidate string, a double, b double, c double, total_trades long, profit_factor double, average_r double, pnl double, max_drawdown double"
    found = W.stability(spark.createDataFrame(rows, schema), {"a": (1.0, 4.5), "b": (0.1, 0.7), "c": (3.0, 20.0)}, [], distance=distance)
    for r in found.collect():
        own = (r["a"], r["b"], r["c"])
        near = [x for x in rows if 0 < sum(p != q for p, q in zip(own, x[1:4], strict=True)) <= distance]
        assert r["neighbors"] == len(near)
        if near:
            assert r["profitable_percent"] == pytest.approx(100 * sum(x[7] > 0 for x in near) / len(near)) and r["median_pf"] == pytest.approx(statistics.median(x[5] for x in near))


def test_measured_by_overlapping_folds(spark):
    """Metrics of each fold and role equal a walk over its trades, and each trade is sorted once, not once for each fold."""
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), START + dt.timedelta(hours=rng.randrange(24 * 400)), i, None if i % 50 == 0 else round(rng.uniform(-400, 390), 2), rng.uniform(-1, 1)) for i in range(3000)]
    trades = spark.createDataFrame(rows, "candidate string, ts timestamp_ntz, trade_id int, pnl double, r double")
    folds = V.folds(spark, "2020-01-01", "2021-02-01", 6, 1)
    found = {(r["fold"], r["role"], r["candidate"]): r for r in W.measured_by_fold(trades, folds, ["candidate"], ["ts", "trade_id"], 1000.0).collect()}
    whole = {(r["candidate"],): r for r in W.measured(trades, ["candidate"], ["ts", "trade_id"], 1000.0).collect()}
    groups = {(c,): [r for r in rows if r[0] == c] for c in "xyz"}
    for f in folds.collect():
        for role, a, b in (("train", f["train_start"], f["train_end"]), ("test", f["train_end"], f["test_end"])):
            groups |= {(f["fold"], role, c): [r for r in rows if r[0] == c and a <= r[1] < b] for c in "xyz"}
    assert len(found) + len(whole) == len(groups) and len(found) > 30
    for key, own in groups.items():
        got, balance, peak, worst = (found | whole)[key], 1000.0, 1000.0, 0.0
        for r in sorted(own, key=lambda r: (r[1], r[2])):
            balance += r[3] or 0.0
            peak = max(peak, balance)
            worst = max(worst, (peak - balance) * 100 / peak)
        values = [r[3] for r in own if r[3] is not None]
        assert got["total_trades"] == len(values)
        assert (got["pnl"], got["average_r"], got["max_drawdown"]) == pytest.approx((sum(values), sum(r[4] for r in own) / len(own), worst))
        assert got["profit_factor"] == pytest.approx(sum(v for v in values if v > 0) / -sum(v for v in values if v < 0))


def test_overlapping_folds_do_not_multiply_trades(spark):
    """Each trade lies in seven folds, and is shuffled once."""
    n = 40000
    trades = spark.range(n).select(
        F.concat_ws("|", F.col("id") % 3, F.lit("1")).alias("candidate"), (F.col("id") % 3).cast("double").alias("a"), F.lit(1.0).alias("b"), F.col("id").alias("trade_id"),
        F.timestamp_seconds(F.lit(1577836800) + F.col("id") * 2400).cast("timestamp_ntz").alias("ts"), (F.rand(1) - 0.5).alias("pnl"), (F.rand(2) - 0.5).alias("r"),
    ).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    found = W.walk_forward(trades, trades.select("candidate", "a", "b").distinct(), V.folds(spark, "2020-01-01", "2023-01-01", 6, 1), {"a": (0, 2), "b": (1, 1)}, ["ts", "trade_id"])
    assert found.count() == 30
    time.sleep(1)  # figures follow the tasks
    assert 0 < written() - before < 160 * n


def test_rising_results_leave_few_rows(spark):
    """Trades that only gain are one row of a chunk's curve, and one for each height that is fallen from."""
    of = lambda pnl: spark.createDataFrame([("x", START + dt.timedelta(seconds=i), i, float(p), 0.0) for i, p in enumerate(pnl)], "candidate string, ts timestamp_ntz, trade_id int, pnl double, r double")
    for pnl, rows, drop in (([1] * 500, 1, 0.0), ([1] * 100 + [-50] + [1] * 300 + [-90, -10], 3, 10000 / 1350), ([-5] + [1] * 200, 1, 0.5)):
        assert W._curves(of(pnl), ["candidate"], ["ts", "trade_id"]).count() == rows
        (r,) = W.measured(of(pnl), ["candidate"], ["ts", "trade_id"], 1000.0).collect()
        assert (r["total_trades"], r["pnl"], r["max_drawdown"]) == pytest.approx((len(pnl), sum(pnl), drop))
    later = of([1] * 10 + [-9, -9]).unionByName(of([-3] + [2] * 40 + [-1]).withColumn("ts", F.col("ts") + F.expr("interval 1 day")))
    (r,) = W.measured(later, ["candidate"], ["ts", "trade_id"], 1000.0).collect()
    assert r["max_drawdown"] == pytest.approx(2100 / 1010)  # below the peak of the day before
    (r,) = W.measured(of([1, 1]), ["candidate"], ["ts", "trade_id"], 0.0).collect()
    assert r["max_drawdown"] == 0.0
