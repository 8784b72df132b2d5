"""Comparing the members of buckets in blocks: no task holds a whole large bucket, and no pair becomes a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(members: DataFrame, most: int, about: DataFrame | None = None) -> DataFrame:
    """Splits buckets into blocks of about ``most`` rows by a hash of ``node``, and sends each row to every pair of
    blocks that its own is part of. ``members`` has ``bucket``, ``node`` and ``size`` (rows of the bucket); added are
    ``first`` and ``second`` (the pair of blocks) and ``own`` (the row's block), and the columns of ``about`` by node. Rows
    come sorted by pair. A bucket of one block stays one group."""
    n = F.ceil(F.col("size") / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(17)), n).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")}).drop("other", "size")
    dealt = dealt if about is None else dealt.join(about, "node")
    keys = ["bucket", "first", "second"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches, keys: list[str]):
    """Groups of rows with equal keys from sorted batches, as tables; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(change), batch.num_rows)
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for end in starts.tolist():
            if at and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the given links between ``n`` places join: each place with the least place it reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]
