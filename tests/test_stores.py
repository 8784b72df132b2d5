"""Stores, quote ingestion, comparisons, replays and stateful streams."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import audits as A
from tidemill.operators import compare as C
from tidemill.operators import replay as P
from tidemill.sources import stores as T
from tidemill.streaming.stateful import stream_segments

T0 = dt.datetime(2025, 1, 1)


def test_ledger_keeps_the_latest_state(spark, tmp_path):
    ledger = T.RunLedger(spark, str(tmp_path / "runs"))
    ledger.append(run_id="a", strategy="s", status="started", params={"x": 1}, at=T0)
    ledger.append(run_id="a", strategy="s", status="finished", params={"x": 1}, result={"net": 2}, at=T0 + dt.timedelta(minutes=1))
    ledger.append(run_id="b", strategy="s", status="started", params={}, at=T0)
    assert {r["run_id"]: r["status"] for r in ledger.runs().collect()} == {"a": "finished", "b": "started"}
    todo = ledger.unfinished(spark.createDataFrame([("a",), ("b",), ("c",)], ["run_id"]))
    assert sorted(r["run_id"] for r in todo.collect()) == ["b", "c"]


def test_fingerprints_ignore_order():
    assert T.fingerprint({"a": 1, "b": [1, 2]}) == T.fingerprint({"b": [1, 2], "a": 1}) != T.fingerprint({"a": 2})


def test_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    T.append_log(rows, str(tmp_path / "log"))
    T.append_log(rows, str(tmp_path / "log"))
    assert T.read_log(spark, str(tmp_path / "log"), "n int, s string").count() == 4


def test_quotes(spark):
    raw = spark.createDataFrame([("2025-01-01 00:00:00.001", "1", "2"), ("2025-01-01 00:00:00.001", "1", "2"), ("1735689600000000123", "1", "x"), ("bad", "1", "2")], ["t", "b", "a"])
    rows = T.ingest_quotes(raw, {"ts": "t", "bid": "b", "ask": "a"}).orderBy("ts").collect()
    assert len(rows) == 2 and rows[0]["ts_ns"] == 1735689600000000123 and rows[0]["ask"] is None
    local = T.ingest_quotes(raw.limit(1), {"ts": "t", "bid": "b", "ask": "a"}, "Europe/Berlin").first()
    assert local["ts"].hour == 23


def test_blank_sides_are_carried(spark):
    raw = spark.createDataFrame([("x", 1, 1.0, None), ("x", 2, None, 3.0), ("x", 3, 2.0, None)], "symbol string, seq int, bid double, ask double")
    assert [(r["bid"], r["ask"]) for r in T.sided_quotes(raw, ["symbol"], ["seq"]).orderBy("seq").collect()] == [(1.0, 3.0), (2.0, 3.0)]


def test_paged_source(spark):
    def fetch(start, end):
        return ((t, 1.0, 2.0, 0.5, 1.5, 10.0) for t in range(start, end, 900))

    spark.dataSource.register(T.paged_source(fetch))
    rows = spark.read.format("paged_ohlc").option("start", "0").option("end", str(900 * 25)).option("page", "10").load()
    assert rows.count() == 25 and rows.rdd.getNumPartitions() == 3


def test_missing_ranges(spark):
    bars = spark.createDataFrame([("x", T0), ("x", T0 + dt.timedelta(minutes=45))], "symbol string, ts timestamp_ntz")
    row = T.missing_ranges(bars, ["symbol"]).first()
    assert row["end"] - row["start"] == 1800


def test_log_audit(spark):
    minutes = [0, 15, 15, 45, 30]
    rows = spark.createDataFrame([("x", i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "symbol string, n int, ts timestamp_ntz")
    row = A.log_audit(rows, ["symbol"], "n", 900).first()
    assert (row["duplicates"], row["reversals"], row["gaps"]) == (1, 1, 0)


def test_greedy_match_equals_plain_python(spark):
    rng = random.Random(2)
    a = [(rng.choice("xy"), T0 + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(80)]
    b = [(rng.choice("xy"), T0 + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(80)]
    frames = [spark.createDataFrame(x, "symbol string, ts timestamp_ntz, id long") for x in (a, b)]
    found = {(r["left_id"], r["right_id"]) for r in C.greedy_match(*frames, ["symbol"], 60).collect()}
    expected, used = set(), set()
    for symbol, ts, i in sorted(a, key=lambda r: (r[1], r[2])):
        near = [(abs((t - ts).total_seconds()), t, j) for s, t, j in b if s == symbol and j not in used and abs((t - ts).total_seconds()) <= 60]
        if near:
            j = min(near)[2]
            used.add(j)
            expected.add((i, j))
    assert found == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("1.0", "1", False), ("1.0", "1.2", True), ("x", "x", False), ("x", "y", True), (None, None, False), (None, "1", True)])
def test_cell_comparison(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(C.differs(F.col("a"), F.col("b"), 0.1).alias("d")).first()
    assert row["d"] is expected


def test_exit_models(spark):
    trades = spark.createDataFrame([(1, "x", "LONG", 100.0, 90.0, T0)], "trade_id long, symbol string, direction string, entry double, stop double, entry_ts timestamp_ntz")
    path = [(100, 112, 99), (112, 112, 100), (100, 121, 100)]
    bars = spark.createDataFrame([("x", T0 + dt.timedelta(minutes=15 * i), float(o), float(h), float(lo)) for i, (o, h, lo) in enumerate(path)], "symbol string, ts timestamp_ntz, open double, high double, low double")
    models = [("2R", 2.0, None, 0.0), ("be", 2.0, 1.0, 0.0), ("half", 2.0, None, 0.5), ("3R", 3.0, None, 0.0)]
    found = {r["model"]: (r["r"], r["reason"]) for r in P.exit_models(trades, bars, ["symbol"], models).collect()}
    assert found == {"2R": (2.0, "TARGET"), "be": (0.0, "BREAKEVEN"), "half": (1.5, "TARGET"), "3R": (None, "OPEN")}


def test_touch_hierarchy(spark):
    frame = lambda rows: spark.createDataFrame(rows, "trade_id long, touch string")
    found = P.resolved(frame([(1, "STOP"), (2, "STOP"), (3, "STOP")]), frame([(1, "TARGET"), (2, "TARGET")]), frame([(1, "STOP"), (2, "AMBIGUOUS")]))
    assert sorted(map(tuple, found.collect())) == [(1, "STOP", "TICK"), (2, "TARGET", "LOWER"), (3, "STOP", "POLICY")]


def test_stream_state_carries_over_batches(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double"
    rows = [("x", T0 + dt.timedelta(minutes=15 * i), float(i)) for i in (0, 1, 2, 4, 5)]
    source = tmp_path / "in"
    source.mkdir()
    names = itertools.count()

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={next(names)}"))

    put(rows[:2])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    run = stream_segments(stream, n=3).writeStream.outputMode("append").format("memory").queryName("segments_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        run.processAllAvailable()
        put(rows[1:])
        run.processAllAvailable()
    finally:
        run.stop()
    found = sorted((r["ts"], r["segment_id"], r["ema"]) for r in spark.table("segments_out").collect())
    assert [x[1] for x in found] == [1, 1, 1, 2, 2] and [x[2] for x in found] == pytest.approx([0, 0.5, 1.25, 4, 4.5])


def test_refused_rows_come_out_and_micro_batches_do_not_matter(spark, tmp_path):
    import random

    from tidemill.streaming.stateful import stream_in_order, table_in_order

    schema, rng = "symbol string, ts timestamp, seq long, close double", random.Random(2)
    rows = [(rng.choice("xy"), T0 + dt.timedelta(minutes=rng.randrange(60)), i, float(i)) for i in range(60)]
    want = sorted((r["symbol"], r["seq"], r["status"], r["behind"]) for r in table_in_order(spark.createDataFrame(rows, schema), ["symbol"]).collect())
    assert {x[2] for x in want} == {"ACCEPTED", "LATE"}
    source, names, found = tmp_path / "in", itertools.count(), []
    source.mkdir()

    def put(part):
        spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.parquet(str(source / f"b={next(names)}"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
        sink = stream_in_order(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        query = sink.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    put(rows[:7])
    put(rows[7:20])
    run()
    put(rows[15:40])  # a restart, and rows that come again
    put(rows[40:])
    run()
    found = [(r["symbol"], r["seq"], r["status"], r["behind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(x for x in found if x[2] != "REPEATED") == want
    assert sorted(x[1] for x in found if x[2] == "REPEATED") == [15, 16, 17, 18, 19]
