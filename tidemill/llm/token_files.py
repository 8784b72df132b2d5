"""Token ids in Arrow files: fixed-size-list batches of equal-length sequences and their masks.

A shard is one Arrow IPC file with the columns ``input_ids`` (fixed-size list of unsigned integers; 16 bits where the
vocabulary allows it) and ``mask`` (fixed-size list of booleans; false on the padding that ends a shard). Every batch
but the last has the same number of rows, so sequence ``i`` lies in batch ``i // batch_rows``, and a memory map gives its
values without a copy. Documents follow one another without gaps; a table beside the shards says where each begins.

Tasks write whole shards under a name of their own attempt; only those that Spark has committed to the index count, so
a task that runs again leaves at most an unused file. Null texts are empty documents (the end id alone); an empty table
gives no shard and no row; repeated ids are kept as they are, in an unspecified order among themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, parts_of, sized, work_path, written
from tidemill.llm.token_ids import default_vocabulary, encoder

INDEX = "doc_id long, shard int, path string, at long, n_tokens long"


class ShardWriter:
    """Appends ids to one shard, a batch at a time."""

    def __init__(self, uri: str, width: int, batch_rows: int, kind: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.width, self.rows, self.kind, self.kept, self.held = width, batch_rows, np.dtype(kind), [], 0
        values = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("input_ids", pa.list_(values, width)), ("mask", pa.list_(pa.bool_(), width))])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.kept.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= (most := self.width * self.rows):
            flat = np.concatenate(self.kept)
            while len(flat) >= most:
                self._batch(flat[:most], most)
                flat = flat[most:]
            self.kept, self.held = [flat], len(flat)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (flat, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.kept)
            self._batch(np.pad(flat, (0, -len(flat) % self.width)), len(flat))
        self.file.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard: sequences, masks, or any run of ids. ``mapped`` gives views of a mapped file (of local
    files; those of others are read); otherwise batches are read by their places in the file, few at a time."""

    def __init__(self, uri: str, mapped: bool = True, kept: int = 4):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if mapped and isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.width = self.file.schema.field("input_ids").type.list_size
        self.batch = functools.lru_cache(maxsize=kept)(self.file.get_batch)
        self.rows = self.batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file where it is mapped) and mask of sequence ``i``."""
        batch, row = self.batch(i // self.rows), i % self.rows
        part = slice(row * self.width, (row + 1) * self.width)
        return batch["input_ids"].values.to_numpy()[part], batch["mask"].values[part].to_numpy(zero_copy_only=False)

    def ids(self, at: int, n: int) -> np.ndarray:
        """``n`` ids from position ``at`` of the shard on; raises if any of them is padding."""
        size, found = self.rows * self.width, []
        while n > 0:
            batch = self.batch(at // size)
            lo = at % size
            hi = min(lo + n, batch.num_rows * self.width)
            if hi <= lo or not all(batch["mask"].values[x].as_py() for x in (lo, hi - 1)):
                raise ValueError("ids beyond the end of a shard")
            found.append(batch["input_ids"].values.to_numpy()[lo:hi])
            at, n = at + hi - lo, n - (hi - lo)
        return np.concatenate(found) if found else np.empty(0, "<u4")


def write_token_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2,
    width: int = 2048, batch_rows: int = 32, uri: str | None = None,
) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the shards in ascending order of ids; returns the index.

    One range exchange orders the documents; each task encodes and writes the shard of its range as a stream."""
    path, uri = vocabulary or default_vocabulary(), uri or work_path(docs.sparkSession, "token-files")

    def shard(batches):
        own, context = encoder(path), TaskContext.get()
        number = context.partitionId()
        name = f"{uri}/shard-{number:06d}-{context.taskAttemptId()}.arrow"
        out = None
        for batch in batches:
            for part, items in parts_of(batch, "text", 4_000_000):
                out = out or ShardWriter(name, width, batch_rows, "<u2" if own.size < 1 << 16 else "<u4")
                at, sizes = out.total, []
                for ids in own.encode(items):
                    flat = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    sizes.append(len(flat))
                    out.append(flat)
                n = np.array(sizes, np.int64)
                columns = [part.column(0), np.full(len(n), number, np.int32), [name] * len(n), at + n.cumsum() - n, n]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["doc_id", "shard", "path", "at", "n_tokens"])
        if out:  # an index row counts only once its task has ended, and with it its file
            out.close()

    pafs_made(uri)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = kept.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(shard, INDEX), "token-index")


def pafs_made(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before this one: its place in its shard, and the shard's own start.
    The running sum goes over one row for each shard."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    joined = index.join(sized(bases, totals.count()), "shard")
    return joined.withColumn("start", F.col("base") + F.col("at")).drop("base")


def read_token_files(index: DataFrame) -> DataFrame:
    """Reads every document's ids back: adds ``ids``, little-endian unsigned 32-bit integers."""
    fields = index.select("doc_id", "path", "at", "n_tokens", "start")

    def read(batches):
        Memo.begin()
        reader = last = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n_tokens")), strict=True)
            ids, size, lo = [], 0, 0
            for i, (path, at, n) in enumerate(rows):
                if path != last:
                    if reader:
                        reader.source.close()
                    reader, last = ShardReader(path, mapped=False, kept=1), path
                ids.append(reader.ids(at, n).astype("<u4").tobytes())
                size += len(ids[-1])
                if size > 2_000_000 or i + 1 == batch.num_rows:
                    part = batch.slice(lo, i + 1 - lo)
                    yield part.append_column("ids", pa.array(ids, pa.binary()))
                    ids, size, lo = [], 0, i + 1

    # As many partitions as shards: Spark would go by the size of the index, which says nothing of the ids.
    shards = index.select("path").distinct().count()
    ordered = fields.repartition(max(1, shards), "path").sortWithinPartitions("path", "at")
    return ordered.mapInArrow(read, "doc_id long, path string, at long, n_tokens long, start long, ids binary")


def op3_token_files(spark, sf_dir):
    from tidemill.llm.common import table

    index = with_starts(write_token_files(table(spark, sf_dir, "documents")))
    return read_token_files(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
