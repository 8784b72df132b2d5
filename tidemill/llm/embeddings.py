"""Near duplicates among embeddings, by randomised-rotation binary codes.

A unit vector o is rotated at random and its signs kept as a code x (a unit vector of +-1/sqrt(d)), with the stored
correction a = <x, o>. For a unit vector q, <x, q> / a is an unbiased estimate of <o, q>, and as
<x, q> = a <o, q> + sqrt(1 - a^2) sqrt(1 - <o, q>^2) z with |z| <= 1, its confidence interval is known; with z = 1
(``confidence`` 1, the default) it is certain. A pair whose upper bound misses the threshold is dropped; every other is
recomputed exactly from the vectors in double precision.

Candidates come from tables of sign bits of further rotations: their width grows with the logarithm of the number of
vectors, and their number is set so that a pair at the threshold itself is missed by all with a probability of at
most ``MISS``. Buckets are compared in blocks, and a pair counts in the first table that holds it, so links are
counted without ever being rows. Equal vectors are one class; links and components are between classes.

Codes and corrections are made once for each class and stored beside the vector. Classes are named by 64-bit hashes of
label and vector: among n classes, two share a name with a probability below n * n / 2 ** 65.

Null, zero and non-finite vectors, those with a null component and those without a label link with nothing. Vectors of
different lengths never link. Rows that repeat an id are vectors of their own; a vector without an id has links like any
other, and gives no name to a component (null where no vector of the component has an id). An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.blocks import forest, in_blocks, runs
from tidemill.llm.common import table, written
from tidemill.llm.components import connected_components

MISS = 1e-6
BLOCK = 1024


@functools.lru_cache(maxsize=8)
def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """At least ``bits`` columns, each ``dim`` of which are a random rotation."""
    rng = np.random.default_rng(seed)
    made = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(1 - -bits // dim)]
    return np.concatenate(made, axis=1)


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a table, tables) for ``n`` vectors."""
    bits = min(48, max(6, math.ceil(math.log2(max(2, n)))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-hit)))


def keys_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of every vector in every table."""
    dim = unit.shape[1]
    signs = unit @ rotations(dim, bits * tables)[:, dim : dim + bits * tables] > 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length lists of numbers as a matrix in double precision, and its rows at length 1."""
    flat = pa.concat_arrays([x.flatten() for x in getattr(column, "chunks", [column])])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and their corrections."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, 1)[:, :dim]
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim)


def near(unit: np.ndarray, packed: np.ndarray, factor: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray, confidence: float):
    """Pairs (places in ``left``, places in ``right``) at or above the threshold: bounds from stored codes, then exactly."""
    dim = unit.shape[1]
    turned = unit[right] @ rotations(dim, 1)[:, :dim]
    codes = (np.unpackbits(packed[left], axis=1, count=dim) * 2.0 - 1.0) / math.sqrt(dim)
    a = factor[left]
    slack = confidence * np.sqrt(np.maximum(0, 1 - a * a)) * math.sqrt(1 - threshold * threshold)
    r, c = np.nonzero(codes @ turned.T >= (a * threshold - slack - 1e-9)[:, None])
    kept_r, kept_c = [], []
    for lo in range(0, len(r), 100_000):
        i, j = r[lo : lo + 100_000], c[lo : lo + 100_000]
        hit = np.einsum("ij,ij->i", unit[left[i]], unit[right[j]]) >= threshold
        kept_r.append(i[hit]), kept_c.append(j[hit])
    return np.concatenate([*kept_r, np.empty(0, int)]), np.concatenate([*kept_c, np.empty(0, int)])


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, confidence: float = 1.0,
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":  # floats are widened in the tasks
        vector = vector.cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    own = own.withColumn("node", F.when(good, F.xxhash64("label", "vector")))
    classes = own.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "vector-classes")
    n = classes.count()
    bits, tables = plan(n, threshold)
    picked = own.filter("node is not null").select("node", "label", "vector").dropDuplicates(["node"])

    def coded(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                packed, factor = codes_of(unit_of(vectors_of(part.column("vector"))))
                yield part.append_column("code", pa.array(map(bytes, packed), pa.binary())).append_column("factor", pa.array(factor))

    kind = picked.schema["vector"].dataType.simpleString()
    label = picked.schema["label"].dataType.simpleString()
    picked = picked.mapInArrow(coded, f"node long, label {label}, vector {kind}, code binary, factor double")
    picked = written(picked.join(classes.select("node", "copies"), "node"), "vectors")

    def deal(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(rows))
                keys = keys_of(unit_of(vectors_of(part.column("vector"))), bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.record_batch([part.column("node"), part.column("bucket"), lists], ["node", "bucket", "keys"])

    light = picked.select("node", F.xxhash64("label", F.size("vector")).alias("bucket"), "vector")
    dealt = light.mapInArrow(deal, "node long, bucket long, keys array<long>")
    dealt = dealt.select("node", "bucket", F.posexplode("keys").alias("at", "key"))
    dealt = dealt.select("node", "at", F.xxhash64("bucket", "at", "key").alias("bucket"))
    dealt = written(dealt, "vector-keys")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = dealt.join(sizes, "bucket").join(picked, "node")

    def compare(batches):
        for rows in runs(batches, ["bucket", "first", "second"]):
            labels = rows["label"].to_pylist()
            length = rows["vector"].combine_chunks().value_lengths().to_numpy()
            if len(set(labels)) > 1 or (length != length[0]).any():
                raise ValueError("two labels in one bucket: equal 64-bit hashes")
            node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
            first, second, side = rows["first"][0].as_py(), rows["second"][0].as_py(), rows["own"].to_numpy()
            left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
            if not len(left) or not len(right):
                continue
            unit = unit_of(vectors_of(rows["vector"]))
            packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(node), -1)
            i, j = near(unit, packed, rows["factor"].to_numpy(), threshold, left, right, confidence)
            i, j = left[i], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            keys, at = keys_of(unit, bits, tables), rows["at"][0].as_py()
            fresh = np.concatenate([(keys[i[x : x + 50_000]] == keys[j[x : x + 50_000]]).argmax(axis=1) for x in range(0, len(i), 50_000)]) == at
            i, j = i[fresh], j[fresh]
            n_links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            linked = np.flatnonzero(n_links)
            yield out(node[linked], node[linked], n_links[linked])
            a, b = forest(len(node), i, j)
            yield out(node[a], node[b], np.zeros(len(a)))

    def out(a, b, n):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    found = written(in_blocks(members, BLOCK).mapInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reached = connected_components(found.filter("a != b"))
    by_class = classes.join(counts, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(smallest, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = own.select("vec_id", "node").join(by_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.col("vec_id").eqNullSafe(component)
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op5_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
