"""Helpers shared by the training-data operators: shared storage, bounded memos, text chunks."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session within one
    machine gets a temporary one; on a cluster that is an error, as other machines could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """``small`` marked for broadcast if its counted rows are at most ``most`` (narrow rows of a few numbers: under
    some 20 MB); beyond that Spark joins by shuffle, with the same result."""
    return F.broadcast(small) if rows <= most else small


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no column of that name."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def fold(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Strings of a column, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def parts_of(batch: pa.RecordBatch | pa.Array, column: str = "", most_chars: int = 1_000_000):
    """Slices of a batch (or of a column) whose texts have about ``most_chars`` bytes together, each with its texts (null
    as the empty text): a worker holds the strings of one slice, not those of the batch."""
    own = batch.column(column) if column else batch
    sizes = np.nan_to_num(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(float))
    at = 0
    while at < len(own):
        upto = max(at + 1, int(np.searchsorted(sizes[at:].cumsum(), most_chars, side="right")) + at)
        yield batch.slice(at, upto - at), [x or "" for x in own.slice(at, upto - at).to_pylist()]
        at = upto


#: Bytes of an entry of a memo besides its key's and value's own (two objects' heads and a place in the dictionary).
ENTRY = 180


class Memo(dict):
    """A memo of a pure function, bounded to about ``most`` bytes, values and overhead included. It has two generations:
    when the new one has half of the bound, it becomes the old one, and the old one is forgotten but for what is asked
    for again. Forgotten keys are computed again, so the bound never changes a result."""

    #: All memos of a worker process.
    known: list[weakref.ref] = []

    def __init__(self, make, most: int = 40_000_000):
        self.make, self.most, self.bytes, self.old = make, most, 0, {}
        Memo.known = [x for x in Memo.known if x() is not None] + [weakref.ref(self)]

    @classmethod
    def begin(cls, *memos: Memo) -> None:
        """Empties all memos but these: a worker that goes from one operator to another keeps one operator's memos, and
        gives the memory of others back."""
        others = [x for ref in cls.known if (x := ref()) is not None and not any(x is y for y in memos)]
        if any(len(x) or x.old for x in others):
            for memo in others:
                memo.clear()
                memo.bytes, memo.old = 0, {}
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    def __missing__(self, key):
        self.room()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.bytes += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        return value

    def room(self) -> None:
        """Starts a new generation where this one is full."""
        if self.bytes > self.most // 2:
            self.old, self.bytes = dict(self), 0
            self.clear()

    def values_of(self, keys: list, make_all) -> list:
        """Values of a group's distinct keys; ``make_all`` makes those of the keys that are not remembered at once."""
        self.room()
        held = list(map(self.get, keys))
        missed = [i for i, x in enumerate(held) if x is None]
        if missed and self.old:
            again = [(i, x) for i in missed if (x := self.old.get(keys[i])) is not None]
            self.fill([keys[i] for i, _ in again], [x for _, x in again])
            for i, x in again:
                held[i] = x
            missed = [i for i in missed if held[i] is None]
        if missed:
            new = [keys[i] for i in missed]
            made = make_all(new)
            self.fill(new, made)
            for i, x in zip(missed, made, strict=True):
                held[i] = x
        return held

    def fill(self, keys: list, values: list[bytes]) -> None:
        self.bytes += sum(map(len, keys)) + sum(map(len, values)) + ENTRY * len(keys)
        self.update(zip(keys, values, strict=True))


#: White space other than the blank and the line feed, and the mark that cuts texts.
_OTHER = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_CUTS = re.compile(r"(?= \S)|(?<=\S\n)(?=\S)")


def plain(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between two other characters."""
    return not (
        "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")
        or (any(map(text.__contains__, _ASCII)) if text.isascii() else _OTHER.search(text))
    )


def chunks(text: str) -> list[str]:
    """Cuts a text where no pre-token of the byte-level BPE patterns can cross: before a blank that a
    non-white-space character follows, and after a single line feed between two of them. The patterns match the same
    pieces in each chunk as in the whole text, so chunks can be encoded (and remembered) one by one."""
    if not text:
        return []
    if not plain(text):
        return [x for x in _CUTS.split(text) if x]
    return marked_chunks(text).split("\0")


def groups_of(items: list[str], most_chars: int = 1_000_000):
    """Runs of consecutive texts of about ``most_chars`` characters; yields (from, to)."""
    at, chars = 0, 0
    for i, x in enumerate(items):
        chars += len(x)
        if chars >= most_chars:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(items):
        yield at, len(items)


def numbered_words(texts: list[str], cut, odd_words, most_chars: int = 4_000_000):
    """Parts of many texts, numbered by Arrow: yields (distinct words, numbers, borders, odd) for runs of texts. ``cut``
    gives a text with a NUL between its parts, or None for a text that must be parted by ``odd_words``; ``odd`` has the
    words of those by their place in the run. Text i has the numbers from borders[i] to borders[i + 1]."""
    for lo, hi in groups_of(texts, most_chars):
        counts, parts, odd = np.zeros(hi - lo + 1, np.int64), [], {}
        for i, x in enumerate(texts[lo:hi]):
            if not x or (marked := cut(x)) is None:
                odd[i] = odd_words(x)
                continue
            parts.append(marked)
            counts[i + 1] = marked.count("\0") + 1
        split = pc.split_pattern(pa.array(["\0".join(parts)] if parts else [], pa.large_string()), "\0")
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        yield words, numbered.indices.to_numpy(), counts.cumsum(), odd


def gathered(held: list[bytes], number: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """For each text, its words' values (32-bit items, any number for each word) in a row, by the words' numbers."""
    size = np.fromiter(map(len, held), np.int64, len(held)) // 4
    items, start = np.frombuffer(b"".join(held), "<u4"), size.cumsum() - size
    lengths = size[number]
    ends = np.append(0, lengths.cumsum())
    flat = items[np.repeat(start[number] - ends[:-1], lengths) + np.arange(ends[-1])]
    at = (4 * ends[borders]).tolist()
    raw = flat.tobytes()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def marked_chunks(text: str) -> str | None:
    """The chunks of a plain text with a NUL between them."""
    return text.replace("\n", "\n\0").replace(" ", "\0 ") if plain(text) else None
