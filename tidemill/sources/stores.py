"""Run stores, append-only logs, specifications and a paged source."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEDGER = "run_id string, strategy string, dataset string, params string, status string, result string, at timestamp_ntz"


def fingerprint(value) -> str:
    """SHA-256 of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def row_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON, its columns in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


class RunLedger:
    """Runs as rows of an append-only Parquet table by strategy; the latest row of a run counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, **row) -> None:
        names = [x.split()[0] for x in LEDGER.split(", ")]
        values = [json.dumps(row.get(n), sort_keys=True) if n in ("params", "result") else row.get(n) for n in names]
        self.spark.createDataFrame([tuple(values)], LEDGER).write.mode("append").partitionBy("strategy").parquet(self.path)

    def runs(self, **equal) -> DataFrame:
        """Current state of all runs whose columns equal the given values."""
        names = [x.split()[0] for x in LEDGER.split(", ")]
        rows = self.spark.read.schema(LEDGER).parquet(self.path)
        kept = [n for n in names if n != "run_id"]
        latest = rows.groupBy("run_id").agg(F.max_by(F.struct(*kept), F.struct("at", F.col("result").isNotNull())).alias("_r")).select("run_id", "_r.*")
        for k, v in equal.items():
            latest = latest.filter(F.col(k) == v)
        return latest

    def unfinished(self, candidates: DataFrame) -> DataFrame:
        """Candidates (``run_id``) that have no finished run: what a resumed search still has to do."""
        done = self.runs(status="finished").select("run_id")
        return candidates.join(done, "run_id", "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a JSON lines log."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def spec(spark: SparkSession, path: str) -> dict:
    """One specification document (JSON): a small driver-side mapping."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def ingest_quotes(raw: DataFrame, columns: dict[str, str], zone: str | None = None) -> DataFrame:
    """Quotes of a raw table: ``columns`` names ts, bid and ask. Exact repeats of time and quote count once. Times keep
    nanoseconds in ``ts_ns`` where they are given as such; a zone is applied to times without one."""
    ts = F.col(columns["ts"]).cast("string")
    stamp = F.try_to_timestamp(ts).cast("timestamp_ntz")
    stamp = stamp if zone is None else F.to_utc_timestamp(stamp.cast("timestamp"), zone).cast("timestamp_ntz")
    number = F.when(ts.rlike(r"^\d{16,20}$"), ts.cast("decimal(20,0)"))
    from_ns = F.timestamp_micros(F.floor(number / 1000).cast("long")).cast("timestamp_ntz")
    rows = raw.select(F.coalesce(from_ns, stamp).alias("ts"), number.cast("long").alias("ts_ns"), *[F.col(columns[s]).try_cast("double").alias(s) for s in ("bid", "ask")])
    return rows.filter("ts is not null").dropDuplicates(["ts", "ts_ns", "bid", "ask"])


def sided_quotes(raw: DataFrame, keys: list[str], order: list[str], reset: str | None = None) -> DataFrame:
    """Quotes whose blank side means unchanged: the last known value is carried forward within each key (and within
    each value of ``reset``, such as a segment)."""
    from tidemill.operators.rolling import carry_forward

    rows = carry_forward(raw, [*keys, *([reset] if reset else [])], order, ["bid", "ask"])
    return rows.filter("bid is not null and ask is not null")


class _Page(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[int, int], Iterator[tuple]]):
        self.start, self.end = int(options["start"]), int(options["end"])
        self.page, self.fetch = int(options.get("page", 1000)) * int(options.get("step", 900)), fetch
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        return [_Page(a, min(a + self.page, self.end)) for a in range(self.start, self.end, self.page)]

    def read(self, partition):
        for attempt in range(self.retries):
            try:
                rows = list(self.fetch(partition.start, partition.end))
                break
            except OSError:
                if attempt + 1 == self.retries:
                    raise
        yield from rows


def paged_source(fetch: Callable[[int, int], Iterator[tuple]], name: str = "paged_ohlc") -> type[DataSource]:
    """A Python data source over a paged candle service: ``fetch(start, end)`` gives rows (epoch seconds, open, high, low,
    close, volume) of a half-open range. Pages are partitions, so they are fetched by tasks and again if one fails."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "epoch long, open double, high double, low double, close double, volume double"

        def reader(self, schema):
            return _PagedReader(self.options, fetch)

    return Paged


def missing_ranges(bars: DataFrame, keys: list[str], step: int = 900) -> DataFrame:
    """What an incremental sync has to fetch: the gaps of each series as half-open ranges of epoch seconds."""
    from tidemill.operators.segments import missing_gaps, seconds, segments

    gaps = missing_gaps(segments(bars, keys, step), keys, step)
    return gaps.select(*keys, seconds("gap_start").alias("start"), (seconds("gap_end") + step).alias("end"))
