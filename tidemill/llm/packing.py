"""Packing by power-of-two decomposition: no sequence holds tokens of two documents, and none is padded.

A document of n ids is cut into pieces of at most ``width`` ids whose lengths are powers of two: whole widths first, then
the binary digits of the rest, largest first. Pieces of equal length form a bucket (``bucket`` is the exponent); each piece
is a sequence of its own, so batches of one bucket stack without padding. The sequence id holds bucket, input partition
and place in it, so that numbering needs neither a shuffle nor a count: one pass over the documents does everything.

A null text is an empty document (one piece, the end id). An empty table gives no rows. Repeated rows and ids are packed
one by one. Very long texts give as many pieces of ``width`` as they need, sent on in bounded batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import parts_of, table
from tidemill.llm.token_ids import MEMO, default_vocabulary, encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())


def cuts(n: int, width: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, largest first."""
    rest = n % width
    return [width] * (n // width) + [1 << k for k in range(width.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1,
    width: int = 2048, memo: int = MEMO, most_chars: int = 4_000_000,
) -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32-bit integers). ``width`` is a power of two;
    ``memo`` and ``most_chars`` bound what a worker remembers and encodes at once, without effect on the rows."""
    if width & (width - 1) or width < 1:
        raise ValueError("width must be a power of two")
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def pieces(batches):
        own, partition, places = encoder(path, memo), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part, items in parts_of(batch, "text", most_chars):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(items), strict=True):
                    ids, at = ids + end, 0
                    n = len(ids) // 4
                    for length in cuts(n, width):
                        bucket = length.bit_length() - 1
                        place = places[bucket] = places.get(bucket, -1) + 1
                        number = bucket << 58 | partition << 34 | place
                        rows.append((doc_id, at, length, ids[4 * at : 4 * (at + length)], n, bucket, number, 0))
                        at += length
                yield as_batch(rows)

    def as_batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(pieces, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "bucket")


def op10_packing(spark, sf_dir):
    return digests(pack(table(spark, sf_dir, "documents")))
