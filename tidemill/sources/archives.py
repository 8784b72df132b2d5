"""Tick files and archives: a data source whose partitions are the members of archives, and the ticks in them.

``TickArchives`` reads CSV files and the CSV members of ZIP files under a path (of any file system that pyarrow knows), each
member in one task, as a stream. The driver sees only names and each member's first 64 kB, from which delimiter and header
are known. Rows keep their number in the member, so the order of a file is never lost to Spark."""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemill.operators.carry import running
from tidemill.operators.rolling import carry_forward
from tidemill.operators.segments import seconds, with_previous

HEAD, STEP = 65_536, 900
#: The header of a terminal's tick export.
EXPORT = ["<DATE>", "<TIME>", "<BID>", "<ASK>", "<LAST>", "<VOLUME>", "<FLAGS>"]


class TickImportError(ValueError):
    """A file that cannot be read as ticks without a correction."""


def _opened(path: str, member: str | None):
    """A binary stream of a file or of a member of an archive."""
    system, where = fs.FileSystem.from_uri(path)
    if member is None:
        return system.open_input_stream(where)
    return zipfile.ZipFile(system.open_input_file(where)).open(member)


def _members(path: str) -> list[tuple[str, str | None]]:
    """(file, member) of every CSV under a path; None for plain files."""
    system, where = fs.FileSystem.from_uri(path)
    info = system.get_file_info(where)
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    listed = system.get_file_info(fs.FileSelector(where, recursive=True)) if info.type == fs.FileType.Directory else [info]
    found: list[tuple[str, str | None]] = []
    for one in sorted(listed, key=lambda x: x.path):
        name = prefix + one.path
        if one.type == fs.FileType.NotFound:
            raise TickImportError(f"no such file: {path}")
        if one.path.lower().endswith(".csv"):
            found.append((name, None))
        elif one.path.lower().endswith(".zip"):
            try:
                inside = [x.filename for x in zipfile.ZipFile(system.open_input_file(one.path)).infolist() if not x.is_dir() and x.filename.lower().endswith(".csv")]
            except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
                raise TickImportError(f"not a ZIP file: {name}") from e
            if not inside:
                raise TickImportError(f"no CSV in {name}")
            found += [(name, x) for x in inside]
        elif info.type != fs.FileType.Directory:
            raise TickImportError("tick files are CSV or ZIP")
    return found


def _shape(path: str, member: str | None) -> tuple[str, list[str], list[list[str]]]:
    """(delimiter, header, first three rows) of a member."""
    with _opened(path, member) as stream:
        raw = stream.read(HEAD)
    try:
        text = io.TextIOWrapper(io.BytesIO(raw), "utf-8-sig", errors="strict" if len(raw) < HEAD else "ignore", newline="").read()
    except UnicodeDecodeError as e:
        raise TickImportError(f"not UTF-8: {path} {member or ''}") from e
    first = text.split("\n", 1)[0]
    delimiter = max(",;\t|", key=first.count)
    if not first.count(delimiter):
        raise TickImportError(f"no delimiter in {path} {member or ''}")
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    header = next(rows)
    if not all(header) or len(set(header)) < len(header):
        raise TickImportError(f"the header of {path} {member or ''} is not unique")
    return delimiter, header, [r for _, r in zip(range(3), rows, strict=False)]


class _Member(InputPartition):
    def __init__(self, path: str, member: str | None, delimiter: str, header: list[str]):
        super().__init__((path, member))
        self.path, self.member, self.delimiter, self.header = path, member, delimiter, header


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Member(p, m, *_shape(p, m)[:2]) for p, m in _members(self.path)]

    def read(self, partition):
        n = len(partition.header)
        with _opened(partition.path, partition.member) as stream:
            rows = csv.reader(io.TextIOWrapper(stream, "utf-8-sig", newline=""), delimiter=partition.delimiter)
            for number, cells in enumerate(rows, start=1):
                if number > 1 and cells:
                    yield partition.path, partition.member, number, dict(zip(partition.header, cells, strict=False)), len(cells) != n


class TickArchives(DataSource):
    """``spark.read.format("tick_archives").load(path)`` after ``spark.dataSource.register(TickArchives)``."""

    @classmethod
    def name(cls):
        return "tick_archives"

    def schema(self):
        return "file string, member string, source_row long, cells map<string,string>, malformed boolean"

    def reader(self, schema):
        return _Reader(self.options["path"])


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """What is under a path before anything is mapped: file, member, delimiter, columns and up to three rows of each member."""
    rows = [(p, m, *_shape(p, m)) for p, m in _members(path)]
    return spark.createDataFrame(rows, "file string, member string, delimiter string, columns array<string>, sample array<array<string>>")


def read_ticks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows under a path as text, a column for each of ``columns`` (null where a file has none such; the export's
    header by default), with ``sample`` (file and member), ``source_row`` and ``malformed`` (too few or too many cells)."""
    spark.dataSource.register(TickArchives)
    rows = spark.read.format("tick_archives").load(path)
    names = columns or EXPORT
    return rows.select(F.concat_ws("!", "file", "member").alias("sample"), "source_row", *[F.col("cells")[c].alias(c) for c in names], "malformed")


def _quote(text: str) -> Column:
    number = F.col(text).try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number)


def _steps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a time and a fault, if any; each sample's quarter hours with the number that are missing before)."""
    stamp = F.coalesce(*[F.try_to_timestamp(F.concat_ws(" ", "<DATE>", "<TIME>"), F.lit(f"yyyy.MM.dd HH:mm:ss{x}")) for x in (".SSS", "")]).cast("timestamp_ntz")
    timed = rows.withColumn("ts", F.when(~F.col("malformed"), stamp))
    chunks = timed.withColumn("_chunk", F.struct("sample", F.floor(F.col("source_row") / 65536).alias("_at")))
    seen = running(chunks, ["sample"], ["source_row"], maxima={"_last": F.unix_micros(F.col("ts").cast("timestamp"))}, before=True).drop("_chunk")
    raw = F.struct(*EXPORT)
    first = seen.filter("ts is not null").groupBy("sample", raw.alias("_raw")).agg(F.min("source_row").alias("_first"))
    seen = seen.withColumn("_raw", raw).join(first, ["sample", "_raw"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    wrong = (~blank("<BID>") & _quote("<BID>").isNull()) | (~blank("<ASK>") & _quote("<ASK>").isNull())
    fault = (
        F.when(F.col("malformed") | F.col("ts").isNull(), "MALFORMED").when(F.unix_micros(F.col("ts").cast("timestamp")) < F.col("_last"), "OUT_OF_ORDER")
        .when(F.col("source_row") > F.col("_first"), "REPEATED").when(blank("<BID>") & blank("<ASK>"), "MALFORMED").when(wrong, "MALFORMED")
    )
    kind = F.when(~blank("<BID>") & ~blank("<ASK>"), "both").when(~blank("<BID>"), "bid_only").when(~blank("<ASK>"), "ask_only")
    quarter = F.timestamp_seconds(F.floor(seconds("ts") / STEP) * STEP).cast("timestamp_ntz")
    seen = seen.withColumns({"fault": fault, "update_type": kind, "bucket": quarter}).drop("_raw", "_first", "_last")
    stamps = seen.filter("ts is not null and coalesce(fault, '') not in ('REPEATED', 'OUT_OF_ORDER')").select("sample", F.col("bucket").alias("ts")).distinct()
    linked = with_previous(stamps, ["sample"])
    missing = F.coalesce(((seconds("ts") - seconds("prev_ts")) / STEP - 1).cast("long"), F.lit(0).cast("long"))
    return seen, linked.select("sample", F.col("ts").alias("bucket"), missing.alias("missing"), "prev_ts")


def sample_ticks(rows: DataFrame) -> DataFrame:
    """Complete quotes of a terminal's exports (``read_ticks``), in which a blank side is unchanged: both sides, whether
    each is carried, and spreads. Sides are carried within one sample, and not over a quarter hour without rows. Rows out
    of order are no ticks here; ``refuse_disorder`` raises for them."""
    seen, quarters = _steps(rows)
    marked = quarters.withColumns({"_chunk": F.struct("sample", F.to_date("bucket").alias("_at")), "_new": F.when((F.col("missing") > 0) | F.col("prev_ts").isNull(), 1).otherwise(0)})
    parts = running(marked, ["sample"], ["bucket"], sums={"segment_id": F.col("_new")}).select("sample", "bucket", "segment_id")
    own = seen.filter("fault is null").join(parts, ["sample", "bucket"]).withColumns({"bid": _quote("<BID>"), "ask": _quote("<ASK>"), "bid_carried": _quote("<BID>").isNull(), "ask_carried": _quote("<ASK>").isNull()})
    whole = carry_forward(own, ["sample", "segment_id"], ["source_row"], ["bid", "ask"]).filter("bid is not null and ask >= bid")
    spread = F.col("ask") - F.col("bid")
    own = ["sample", "source_row", "ts", "bucket", "segment_id", "bid", "ask", "bid_carried", "ask_carried", "update_type"]
    return whole.select(*own, spread.alias("spread"), (spread / F.col("bid") * 10_000).alias("spread_bps"))


def sample_counters(rows: DataFrame) -> DataFrame:
    """A row for each sample: rows, ticks, one-sided and two-sided updates, malformed rows (a crossed quote is one), repeats,
    repeated times, rows out of order, and quarter hours that are missing."""
    seen, quarters = _steps(rows)
    good = F.col("fault").isNull()
    counts = seen.groupBy("sample").agg(
        F.count("*").alias("rows"), *[F.count(F.when(good & (F.col("update_type") == k), 1)).alias(k) for k in ("both", "bid_only", "ask_only")],
        *[F.count(F.when(F.col("fault") == k, 1)).alias(k.lower()) for k in ("MALFORMED", "REPEATED", "OUT_OF_ORDER")], F.count("ts").alias("_times"), F.count_distinct("ts").alias("_stamps"),
    )
    ticks = sample_ticks(rows).groupBy("sample").agg(F.count("*").alias("ticks"))
    gaps = quarters.groupBy("sample").agg(F.sum("missing").alias("missing_quarters"))
    found = counts.join(ticks, "sample", "left").join(gaps, "sample", "left").na.fill(0, ["ticks", "missing_quarters"])
    return found.withColumn("repeated_times", F.col("_times") - F.col("_stamps")).drop("_times", "_stamps")


def refuse_disorder(rows: DataFrame) -> DataFrame:
    """The rows, whose task fails at one that is out of order in its sample."""
    seen, _ = _steps(rows)
    text = F.concat(F.lit("a time falls in "), "sample", F.lit(" at row "), F.col("source_row").cast("string"))
    return seen.withColumn("ts", F.when(F.col("fault").eqNullSafe("OUT_OF_ORDER"), F.raise_error(text).cast("timestamp_ntz")).otherwise(F.col("ts")))
