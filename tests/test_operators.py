"""DataFrame operators on small tables against values computed by hand or by plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import candles as cx
from tidemill.operators import bars as B
from tidemill.operators import joins as J
from tidemill.operators import metrics as M
from tidemill.operators import rolling as R
from tidemill.operators import search as V
from tidemill.operators import segments as S
from tidemill.sources import ohlcv as O

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def candles(spark, rows):
    """Rows (minute, close) or (minute, open, high, low, close)."""
    full = [(r[0], r[1], r[1] + 1, r[1] - 1, r[1]) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([("x", minutes(m), float(o), float(h), float(lo), float(c), 1.0) for m, o, h, lo, c in full], SCHEMA)


def test_segments_and_gaps(spark):
    bars = candles(spark, [(0, 1), (15, 1), (60, 1), (75, 1), (90, 1), (1500, 1), (1515, 1)])
    found = S.segments(bars, ["symbol"])
    rows = {r["segment_id"]: (r["segment_start"], r["candles"]) for r in found.collect()}
    assert rows == {1: (minutes(0), 2), 2: (minutes(60), 3), 3: (minutes(1500), 2)}
    gaps = sorted((r["gap_start"], r["gap_end"], r["missing"]) for r in S.missing_gaps(found, ["symbol"]).collect())
    assert gaps[0] == (minutes(30), minutes(45), 2) and gaps[1][2] == 93
    assert S.largest_segment(found, ["symbol"]).first()["segment_id"] == 2
    assert S.missing_calendar(bars, ["symbol"]).count() == 95


def test_largest_segment_prefers_the_first(spark):
    found = S.segments(candles(spark, [(0, 1), (15, 1), (60, 1), (75, 1)]), ["symbol"])
    assert S.largest_segment(found, ["symbol"]).first()["segment_start"] == minutes(0)


def test_quality_report(spark):
    bars = candles(spark, [(0, 1, 2, 0.5, 1), (30, 1, 0.5, 0.7, 1)])
    row = S.quality_report(bars, ["symbol"]).first()
    assert (row["missing"], row["invalid"], row["duplicates"]) == (1, 1, 0)


def test_prepare_keeps_the_last_of_equal_times(spark):
    raw = spark.createDataFrame([("2025-01-01T00:15:00Z", "2", "3", "1", "2", "1"), ("2025-01-01T00:00:00Z", "1", "2", "0.5", "1", "1"), ("2025-01-01T00:15:00Z", "2", "4", "1", "x", "1"), (None, "1", "1", "1", "1", "1")], ["Time", "Open", "High", "Low", "Close", "Vol"])
    rows = O.prepared(raw).orderBy("ts").collect()
    assert len(rows) == 2 and rows[1]["high"] == 4 and rows[1]["close"] is None


@pytest.mark.parametrize(("unit", "factor"), [("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)])
def test_epoch_units(spark, unit, factor):
    raw = spark.createDataFrame([(str(1735689600 * factor),)], ["timestamp"])
    assert O.epoch_unit(raw, "timestamp") == unit
    assert raw.select(O.parsed_time(F.col("timestamp"), unit).alias("t")).first()["t"] == T0


def test_csv_round_trip(spark, tmp_path):
    bars = candles(spark, [(0, 1), (15, 2)])
    O.write_ohlcv(bars, str(tmp_path / "out"))
    again = O.read_ohlcv(spark, str(tmp_path / "out"))
    assert sorted(again.collect()) == sorted(bars.drop("symbol").collect())


def test_terminal_bars(spark, tmp_path):
    path = tmp_path / "bars.tsv"
    path.write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2025.01.01\t00:15:00\t1\t2\t0.5\t1.5\t10\t0\t7\n")
    row = O.read_terminal_bars(spark, str(path)).first()
    assert row["ts"] == minutes(15) and row["spread_price"] == pytest.approx(0.07)


def test_quotes_are_checked(spark):
    rows = spark.createDataFrame([(1.0, 1.5), (0.0, 1.0), (2.0, 1.0), (None, 1.0), (float("nan"), 2.0), (1.0, float("inf"))], ["bid", "ask"])
    found = O.normalised_quotes(rows).collect()
    assert len(found) == 1 and found[0]["spread_bps"] == pytest.approx(4000)


def test_merge_prefers_the_later_table(spark):
    a, b = candles(spark, [(0, 1), (15, 1)]).drop("symbol"), candles(spark, [(15, 9)]).drop("symbol")
    assert [r["close"] for r in O.merged(a, b).orderBy("ts").collect()] == [1, 9]


def test_complete_hours_need_all_parts(spark):
    bars = candles(spark, [(0, 1), (15, 2), (30, 3), (45, 4), (60, 5), (75, 5), (105, 5)])
    found = B.complete(bars, ["symbol"], 3600, 900).collect()
    assert len(found) == 1 and (found[0]["open"], found[0]["close"], found[0]["high"]) == (1, 4, 5)


def test_hour_context_shows_the_last_complete_hour(spark):
    bars = candles(spark, [(480 + 15 * i, 100 + i // 4) for i in range(12)] + [(660, 103)])
    rows = {r["ts"]: r["h1_close"] for r in B.hour_context(bars, ["symbol"]).collect()}
    assert all(rows[minutes(480 + 15 * i)] is None for i in range(4))
    assert rows[minutes(600)] == 101 and rows[minutes(645)] == 101 and rows[minutes(660)] == 102


def test_hour_context_needs_a_whole_hour(spark):
    bars = candles(spark, [(495, 1), (510, 1), (525, 1), (540, 2)])
    assert all(r["h1_close"] is None for r in B.hour_context(bars, ["symbol"]).collect())


def test_asof_matches_plain_python(spark):
    rng = random.Random(3)
    left = [("x", minutes(rng.randrange(0, 9000)), i) for i in range(200)]
    right = sorted({rng.randrange(0, 9000) for _ in range(60)})
    a = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, id int")
    b = spark.createDataFrame([("x", minutes(m), float(m)) for m in right], "symbol string, ts timestamp_ntz, v double")
    for r in J.asof_backward(a, b, ["symbol"], "v").collect():
        before = [m for m in right if minutes(m) <= r["ts"]]
        assert r["asof_v"] == (float(before[-1]) if before else None)


def test_first_passage(spark):
    bars = candles(spark, [(0, 10, 10, 10, 10), (15, 10, 11, 9.5, 10), (30, 10, 13, 7, 10), (45, 10, 10, 10, 10)])
    rows = [r["resolution"] for r in J.first_passage(bars, ["symbol"], 1.0, 2.0).orderBy("ts").collect()]
    assert rows == ["TARGET", "AMBIGUOUS", "OPEN", "OPEN"]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, None), (3, 1.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 3.0), (2, 1.0, None), (4, 1.0, 1.0)], "k int, x double, y double")
    rows = {r["k"]: (r["place"], r["first_difference"]) for r in J.reconcile(a, b, ["k"], ["x", "y"]).collect()}
    assert rows == {1: ("both", "y"), 2: ("both", None), 3: ("left_only", None), 4: ("right_only", None)}


def trades(spark, values):
    return spark.createDataFrame([("x", i, float(v), float(v)) for i, v in enumerate(values)], "symbol string, n int, pnl double, r double")


def test_trade_stats(spark):
    row = M.trade_stats(trades(spark, [200, -102]), ["symbol"]).first()
    assert row["profit_factor"] == pytest.approx(200 / 102) and row["net"] == 98
    only = M.trade_stats(trades(spark, [5, 0]), ["symbol"]).first()
    assert only["profit_factor"] == float("inf") and only["breakeven"] == 1
    none = M.trade_stats(trades(spark, [5]), ["symbol"], infinite=False).first()
    assert none["profit_factor"] is None


def test_path_metrics(spark):
    r = [1, 1, -1, -1, -1, 2, 0.5, -0.5, 3, -1]
    rows = trades(spark, r)
    assert M.max_drawdown(rows, ["symbol"], ["n"], 0.0).first()["max_drawdown"] == 3
    streak = M.streaks(rows, ["symbol"], ["n"]).first()
    assert (streak["max_wins"], streak["max_losses"]) == (2, 3)
    assert M.worst_rolling(rows, ["symbol"], ["n"], 3).first()["worst_rolling"] == -3
    assert M.longest_recovery(rows, ["symbol"], ["n"]).first()["longest_recovery"] == 7


def test_breakeven_and_streaks(spark):
    rows = trades(spark, [-1, 0, -1])
    assert M.streaks(rows, ["symbol"], ["n"]).first()["max_losses"] == 1
    assert M.streaks(rows, ["symbol"], ["n"], breakeven_resets=False).first()["max_losses"] == 2


def test_outliers(spark):
    rows = M.outlier_dependence(trades(spark, [1, 1, -1, -1, -1, 2, 0.5, -0.5, 3, 3.5]), ["n"]).collect()
    assert rows[0]["top_share"] == pytest.approx(3.5 / 7.5)


def test_buckets(spark):
    rows = M.bucketed(trades(spark, [0, 1, 2, 3]), "r", [0, 1, 3]).orderBy("n").collect()
    assert [r["bucket"] for r in rows] == ["0-1", "1-3", "1-3", "1-3"]


def test_pivots(spark):
    highs = [1, 2, 5, 3, 5, 1, 1]
    bars = candles(spark, [(15 * i, h - 0.5, h, h - 1, h - 0.5) for i, h in enumerate(highs)])
    rows = R.pivot_highs(bars, ["symbol"]).orderBy("ts").collect()
    assert [r["pivot_level"] for r in rows] == [None, None, None, None, 5, 5, 5]
    assert [r["pivot_age"] for r in rows][4:] == [2, 3, 4]


def test_previous_extremes_exclude_the_bar(spark):
    rows = R.previous_extremes(candles(spark, [(0, 1), (15, 5), (30, 3)]), ["symbol"], 2).orderBy("ts").collect()
    assert [r["prev_high_2"] for r in rows] == [None, None, 6]


def test_binomial_tail(spark):
    one = spark.range(1).select(cx.binomial_tail(F.lit(8), F.lit(10), 0.5).alias("p")).first()["p"]
    assert one == pytest.approx(56 / 1024)


def test_floor_to_step(spark):
    assert spark.range(1).select(cx.floor_to_step(F.lit(0.29999), 0.01).alias("v")).first()["v"] == pytest.approx(0.29)


def test_bootstrap_is_reproducible_and_keeps_the_sum_when_permuted(spark):
    results = [1.0, -1.0, 2.0, -0.5]
    a = sorted(V.bootstrap(spark, results, 20, seed=3).collect())
    assert a == sorted(V.bootstrap(spark, results, 20, seed=3).repartition(3).collect())
    assert {round(r["terminal_r"], 9) for r in V.bootstrap(spark, results, 20, permute=True).collect()} == {1.5}


def test_folds_do_not_leak(spark):
    folds = V.folds(spark, "2020-01-01", "2021-01-01", 6, 3)
    assert folds.count() == 2
    rows = spark.range(366).select((F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("ts"))
    assert all(r["clean"] for r in V.leakage(V.by_fold(rows, folds)).collect())


def test_empty_tables(spark):
    none = candles(spark, [(0, 1)]).filter("false")
    assert S.segments(none, ["symbol"]).count() == 0
    assert B.hour_context(none, ["symbol"]).count() == 0
    assert S.quality_report(none, ["symbol"]).count() == 0


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    from tidemill.streaming.bars import streaming_bars

    rows = [("x", dt.datetime(2025, 1, 1, 0, m), float(m % 7)) for m in range(0, 60, 2)] + [("x", dt.datetime(2025, 1, 1, 3, 0), 0.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    run = streaming_bars(stream, ["symbol"]).writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    batch = streaming_bars(ticks, ["symbol"]).filter("ts < timestamp'2025-01-01 03:00:00'")
    assert sorted(spark.table("bars_out").collect()) == sorted(batch.collect())
