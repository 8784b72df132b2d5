"""Set-similarity join on word n-grams, by a partitioned universe and the pigeonhole principle.

A document's set holds the 64-bit hashes of its distinct word n-grams. Sets are grouped into size bands so narrow that a
partner lies in the same or the next band. For each band a hash cuts the universe of n-grams into segments. Sets whose
similarity reaches the threshold differ in at most H elements, so of H + 1 segments at least one holds the same subset in
both, and of fewer segments at least one differs by at most one element. Each set is therefore indexed by

* the subset and its one-deletion neighbours in the band's first segments (each of which covers two of the H + 1), and
* the subsets of its most selective other segments, as many as are then missing.

How many segments get deletion neighbours is a choice by cost, for each band: index entries against the candidates
expected at the band's number of sets. Which of the others a set uses is a choice by cost too: there are half again as many
as needed, and the fullest are taken, in an order that depends on the subset alone. Of two similar sets, the one with the
higher last choice has an equal segment among its choices, and the other has chosen that segment as well: no pair is lost.

Equal sets are one node. In each bucket of the index all nodes are verified against the most connected one; links that
only other pairs can show are searched in the buckets whose nodes are then still apart, in blocks, with a bound from
counts of elements by hash; every link is verified exactly on the sets. So a large group of near copies costs rows in
proportion to its size. Nodes are 64-bit hashes of sets: among n documents, two different sets share one with a
probability below n * n / 2 ** 65.

Documents without words, and null texts, have empty sets and link with nothing. Rows that repeat an id are documents of
their own in one component. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemill.llm.blocks import in_blocks, runs
from tidemill.llm.common import Memo, parts_of, sized, table, unused, written
from tidemill.llm.components import connected_components

BLOCK = 1024
SKETCH = 1024
RHO = 0.02  # assumed chance that a set of the same band shares a given element, for the choice by cost

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S27, _S31, _S33 = np.uint64(27), np.uint64(31), np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing function on unsigned 64-bit integers."""
    x = (x ^ (x >> _S31)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S33)


_WORDS = Memo(xxh3_64_intdigest, 30_000_000)


def keep_words() -> None:
    Memo.begin(_WORDS)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a whole text; with fewer words, of the sequence as one. A-Z are
    lower-cased, and words end at blanks and the control characters 9 to 13."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(known))
    last = len(known) - width + 1
    found = known[:last] + _A
    for i in range(1, width):
        found = mixed(found) + known[i : i + last]
    return np.unique(mixed(found + np.uint64(width) if width < n else found))


def node_of(tokens: np.ndarray) -> int:
    """The 64-bit name of a set."""
    total = int(mixed(tokens + _C).sum(dtype=np.uint64)) + len(tokens) * int(_A)
    return ((total + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den; ``most`` bounds the difference of sets of sizes a and b."""

    num: int
    den: int

    def most(self, a, b):
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, size: int) -> int:
        return size * self.den // self.num

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


@dataclass(frozen=True)
class Scheme:
    """Segments for the pairs whose smaller set has a size from ``low`` to ``high``."""

    low: int
    high: int
    deleting: int
    exact: int

    @property
    def segments(self) -> int:
        return self.deleting + self.exact


def bands(limit: Threshold, largest: int) -> list[tuple[int, int]]:
    """Sizes (from, to) of the bands up to the largest size."""
    found, low = [], 1
    while low <= largest:
        high = max(low, limit.largest(low))
        found.append((low, high))
        low = high + 1
    return found


def allocate(limit: Threshold, low: int, high: int, sets: int) -> Scheme:
    """The cheapest number of segments with deletion neighbours, for a band with that many possible partners."""
    need = limit.most(high, limit.largest(high)) + 1
    best = None
    for deleting in sorted({(need + 1) // 2 * i // 64 for i in range(65)}):
        missing = max(0, need - 2 * deleting)
        exact = -(-3 * missing // 2)
        t = high / (deleting + exact)
        entries = deleting * (1 + t) + missing
        candidates = sets * (deleting * (t + 2) * RHO ** max(t - 1, 0) + missing * RHO ** (1.2 * t))
        if best is None or entries + 2 * candidates < best[0]:
            best = entries + 2 * candidates, Scheme(low, high, deleting, exact)
    return best[1]


def schemes_for(limit: Threshold, by_size: dict[int, int], largest: int) -> list[Scheme]:
    """One scheme for each band, given about how many sets there are of each size."""
    found = bands(limit, largest)
    sets = [sum(n for size, n in by_size.items() if low <= size <= high) for low, high in found] + [0]
    return [allocate(limit, low, high, sets[i] + sets[i + 1]) for i, (low, high) in enumerate(found)]


def signatures(tokens: np.ndarray, limit: Threshold, schemes: list[Scheme]) -> np.ndarray:
    """The index entries of a set: in its own band's scheme, and in the one before as the larger set."""
    n = len(tokens)
    at = next(i for i, s in enumerate(schemes) if s.low <= n <= s.high)
    found = []
    for i in (at, at - 1):
        if i < 0:
            break
        scheme = schemes[i]
        partner = limit.largest(n) if i == at else scheme.high
        if i != at and limit.largest(scheme.high) < n:
            break
        missing = limit.most(n, partner) + 1 - 2 * scheme.deleting
        weight = mixed(tokens ^ _B)
        segment = ((tokens >> _S31) % np.uint64(scheme.segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        count = np.bincount(segment, minlength=scheme.segments)
        sums = np.concatenate([np.zeros(1, np.uint64), weight[order].cumsum(dtype=np.uint64)])
        ends = count.cumsum()
        subset = sums[ends] - sums[ends - count]
        name = (np.arange(scheme.segments, dtype=np.uint64) + np.uint64(i << 32)) * _A
        if missing > 0:
            own = np.arange(scheme.deleting, scheme.segments)
            chosen = own[np.lexsort((own, subset[own], -count[own]))[:missing]]
            found.append(mixed(subset[chosen] ^ name[chosen]))
        if scheme.deleting:
            few = np.arange(scheme.deleting)
            found.append(mixed(subset[few] ^ name[few]))
            inside = segment < scheme.deleting
            found.append(mixed((subset[segment[inside]] - weight[inside]) ^ name[segment[inside]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Counts of elements by hash: the sum of absolute differences never exceeds the sets' difference."""
    width = min(SKETCH, 1 << max(4, (len(tokens) // 4).bit_length()))
    return np.minimum(np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))


def _index(docs: DataFrame, n: int, limit: Threshold, schemes: list[Scheme]) -> DataFrame:
    """Index entries (sig, node) of every set, which a task gives once for equal sets, and a row (with ``doc``: id and
    size of the set) for every document."""

    def run(batches):
        keep_words()
        seen: set[int] = set()
        for batch in batches:
            for part, items in parts_of(batch, "text", 2_000_000):
                sigs, nodes, docs = [], [], []
                if len(seen) > 100_000:  # a set given again is the same entries again, which are told apart later
                    seen.clear()
                for doc_id, key, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), items, strict=True):
                    tokens = shingles(text, n)
                    node = node_of(tokens) if len(tokens) else None
                    docs.append((doc_id, len(tokens), node, key))
                    if node is not None and node not in seen:
                        seen.add(node)
                        sigs.append(signatures(tokens, limit, schemes))
                        nodes.append(np.full(len(sigs[-1]), node))
                yield out(sigs, nodes, docs)

    def out(sigs, nodes, docs):
        entries = np.concatenate([np.empty(0, np.uint64), *sigs]).astype(np.int64)
        ids = pa.array([x[0] for x in docs], pa.int64())
        # A document's own row goes to a bucket of its own, by a hash of its id.
        spread = mixed(np.array([-1 if x[0] is None else x[0] for x in docs], np.int64).view(np.uint64) ^ _C).view(np.int64)
        sig = pa.array(np.concatenate([entries, spread]))
        named = pa.array(np.concatenate([np.empty(0, np.int64), *nodes]), pa.int64())
        node = pa.concat_arrays([named, pa.array([x[2] for x in docs], pa.int64())])
        kind = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])
        own = pa.StructArray.from_arrays([ids, *(pa.array([x[i] for x in docs], pa.int64()) for i in (1, 3))], fields=list(kind))
        return pa.record_batch([sig, node, pa.concat_arrays([pa.nulls(len(entries), kind), own])], ["sig", "node", "doc"])

    return docs.mapInArrow(run, "sig long, node long, doc struct<doc_id:long,n:long,key:long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """The sets themselves: node, tokens (sorted, 64 bits each), sketch."""

    def run(batches):
        keep_words()
        for batch in batches:
            for _, items in parts_of(batch, "text", 2_000_000):
                sets = [shingles(x, n) for x in items]
                yield out([(node_of(x), x.tobytes(), sketch(x).tobytes()) for x in sets])

    def out(rows):
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "tokens", "sketch"])

    return docs.select("text").mapInArrow(run, "node long, tokens binary, sketch binary")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold, exactly."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                keep.append(limit.linked(int((a[at] == b).sum()), len(a), len(b)))
            yield pa.record_batch([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    near = F.octet_length("ta") * limit.num <= F.octet_length("tb") * limit.den
    near &= F.octet_length("tb") * limit.num <= F.octet_length("ta") * limit.den
    return joined.filter(near).mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket and are in different components, less those that a bound from their
    sketches rules out, and those of the bucket's lead. A pair that shares more buckets comes from the least of those
    among both nodes' first entries."""

    def run(batches):
        for rows in runs(batches, ["bucket", "first", "second"]):
            first, second, side = rows["first"][0].as_py(), rows["second"][0].as_py(), rows["own"].to_numpy()
            bucket, lead = rows["bucket"][0].as_py(), rows["lead"][0].as_py()
            node, component, size = (rows[c].to_numpy() for c in ("node", "component", "n"))
            left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
            sketches = rows["sketch"].to_pylist()
            width = min(map(len, sketches))
            counts = np.stack([np.frombuffer(x, np.uint8).astype(np.int16).reshape(-1, width).sum(axis=0) for x in sketches]).astype(np.int16)
            sigs: dict[int, set] = {}
            for lo in range(0, len(left), 64):
                i = left[lo : lo + 64]
                a, b = component[i][:, None] != component[right], node[i][:, None] != node[right]
                c = (size[i][:, None] * limit.num <= size[right] * limit.den) & (size[right] * limit.num <= size[i][:, None] * limit.den)
                d = (node[i][:, None] != lead) & (node[right] != lead)
                e = i[:, None] < right if first == second else True
                x, y = np.nonzero(a & b & c & d & e)
                x, y = i[x], right[y]
                keep = [np.empty(0, bool)]
                for at in range(0, len(x), 8_192):
                    p, q = x[at : at + 8_192], y[at : at + 8_192]
                    keep.append(np.abs(counts[p] - counts[q]).sum(axis=1) <= limit.most(size[p], size[q]))
                near = np.flatnonzero(np.concatenate(keep))
                pairs = []
                for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    for z in (p, q):
                        if z not in sigs:
                            sigs[z] = set(rows["sigs"][z].as_py())
                    if min(sigs[p] & sigs[q], default=bucket) == bucket:
                        pairs.append((node[p], node[q]))
                if pairs:
                    found = np.sort(np.array(pairs, np.int64), axis=1)
                    yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def ngram_components(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id its links reach), key (a hash of its
    text) and component_key (that of the row which gives the component its id)."""
    limit = Threshold(*threshold)
    if not 0 < limit.num <= limit.den:
        raise ValueError("the threshold must be above 0 and at most 1")
    own = _own(docs, id_col, text_col)
    # Sizes of sets are estimated from lengths for the choice by cost only: a few hundred rows of counts.
    length = F.greatest(F.octet_length("text"), F.lit(1))
    histogram = own.filter("text is not null").groupBy(F.floor(F.log(length / 6.0 + 1) * 10).alias("bin")).agg(F.count("*").alias("n"), F.max(length).alias("most")).collect()
    by_size = {max(1, round(math.exp(r["bin"] / 10))): r["n"] for r in histogram}
    schemes = schemes_for(limit, by_size, max((r["most"] for r in histogram), default=0) // 2 + 1)

    bucket = Window.partitionBy("sig")
    entries = _index(own, n, limit, schemes)
    entries = entries.withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket)})
    entries = written(entries.filter("low < high or doc is not null").select("sig", "node", "doc"), "shared-entries")
    light = entries.filter("doc is not null").select("doc.doc_id", F.col("doc.n").alias("n_shingles"), "doc.key", "node")
    nodes = light.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first"), F.max("n_shingles").alias("n"))
    nodes = written(nodes, "set-nodes")
    shared = entries.filter("doc is null").select("sig", "node").distinct()
    sizes = shared.groupBy("sig").agg(F.count("*").alias("size"))
    shared = written(shared.join(sizes, "sig"), "bucket-members")
    # A node's entries are bounded by its own text; the first few serve to tell where a pair belongs.
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"), F.slice(F.sort_array(F.collect_list("sig")), 1, 16).alias("sigs"))
    weight = written(weight, "node-entries")
    leads = shared.join(weight.select("node", "weight"), "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("top"))
    leads = leads.select("sig", F.col("top.node").alias("lead"))
    led = written(shared.join(leads, "sig"), "led-members")
    pairs = led.filter("node != lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()

    involved = written(weight.select("node").join(nodes, "node").select("node", "rep"), "involved")
    ids = involved.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(_sets(own.join(sized(ids, involved.count()), "doc_id", "left_semi"), n).dropDuplicates(["node"]), "sets")
    links = written(_verified(pairs, sets, limit), "set-links")
    reached = connected_components(links)
    reached = weight.select("node").join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    placed = led.filter("size > 2").join(reached, "node")
    mixed_buckets = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    placed = placed.join(mixed_buckets.select("sig"), "sig").withColumnRenamed("sig", "bucket")
    about = sets.select("node", "sketch").join(weight.select("node", "sigs"), "node").join(nodes.select("node", "n"), "node")
    more = _apart(in_blocks(placed, BLOCK, about), limit).distinct()
    more = written(_verified(written(more, "open-pairs"), sets, limit), "set-links")
    final = reached if more.isEmpty() else connected_components(links.union(more))
    smallest = nodes.join(final, "node").groupBy("component").agg(F.min("first").alias("low"))
    by_node = nodes.join(final, "node", "left").join(smallest, "component", "left")
    by_node = by_node.select("node", F.coalesce("low", "first").alias("low"))
    joined = light.join(by_node, "node", "left")
    component, key = F.coalesce("low.doc_id", "doc_id").alias("component_id"), F.coalesce("low.key", "key").alias("component_key")
    return joined.select("doc_id", "n_shingles", component, "key", key)


def op8_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), 4, (85, 100)).drop("key", "component_key")


def dedup_stage(spark, docs, sf_dir):
    """Keeps one document of each component: the row of the smallest id (and, where that id repeats, of the smallest hash
    of its text). Decisions go by id and text together. Rows that repeat both stay once; rows without an id stay."""
    found, key = written(ngram_components(docs), "components"), unused(docs, "text_key")
    gone = found.filter("doc_id != component_id or key != component_key").select("doc_id", F.col("key").alias(key)).distinct()
    gone = written(gone.filter("doc_id is not null"), "duplicates")
    twice = found.groupBy("doc_id", "key").count().filter("count > 1 and doc_id is not null")
    twice = written(twice.select("doc_id").distinct(), "repeated-ids")
    kept = docs.withColumn(key, F.xxhash64("text")).join(sized(gone, gone.count()), ["doc_id", key], "left_anti")
    if n := twice.count():
        once = kept.join(sized(twice, n), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(sized(twice, n), "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)
