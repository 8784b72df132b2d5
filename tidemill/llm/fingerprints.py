"""Document fingerprints by a randomised edit embedding.

A pointer walks over the characters. At every step the embedding takes the character under the pointer, and a random
bit, shared by all documents and chosen by step and character, says whether the pointer moves on. Two texts at a small
edit distance fall back into step after each edit, so their embeddings differ in few places: edit distance becomes
Hamming distance. Every text is walked once, from its start to its end: the step at which the pointer leaves a character
is looked up in a table of the next set bits, so that the walk takes one look for each character. The table holds
``PERIOD`` steps; each later period takes the same table with the classes of characters turned by another amount.

The fingerprint samples the embedding: ``PLACES`` fixed places, the same number in each doubling of the length, each
giving 8 bits of a hash of the symbols that follow it. A place beyond the end of a short text holds 0, a mark no real
symbol has (and is left out at a fingerprint's end), so lengths are compared too. ``likeness`` is the share of equal places, each weighted by the part of the
longer text that it stands for, less what unrelated texts have in common by chance.

``near_duplicates`` bands the sampled places: documents with an equal band are candidates, and pairs are verified by
likeness; no pair at the threshold is lost. Null texts are empty; empty texts have fingerprints of marks alone and are like each other (1) and unlike all
others (0). Equal texts have equal fingerprints. Repeated rows and ids are handled one by one; the order among rows
with one id is by the text. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.blocks import forest, in_blocks, runs
from tidemill.llm.common import sized, table, written
from tidemill.llm.components import connected_components

BAND = 4  # sampled places of a band; a divisor of EACH, so that the places of a band have one weight
BLOCK = 512
STEPS = 2  # steps for each character: the pointer moves at every second step on average
SCALES, EACH = 24, 32  # doublings of the length that have sampled places, and places in each
SPAN = 6  # symbols that one place hashes
CHANCE = 0.01  # share of places that are equal in unrelated texts
PLACES = SCALES * EACH
STRETCH = 1 << (SCALES + 4)  # characters up to the end of the last sampled place: one walk
PERIOD = 1 << 15  # steps of the table of random bits
SEED = 20240101


class Bits:
    """The walk's random bits: ``bits()[step][class]``."""

    def __init__(self):
        self.rows = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
        self.rows[-1] = 1  # every pointer moves at a period's last step, so that periods are walked one by one
        self.rows[:, 0] = 0  # the pointer stays at the end
        at = np.arange(PERIOD, dtype=np.int32)[:, None]
        following = np.minimum.accumulate(np.where(self.rows[:, 1:], at, PERIOD)[::-1], axis=0)[::-1]
        skips = np.zeros((PERIOD, 256), np.uint8)
        skips[:, 1:] = following - at + 1
        self.skips = skips.tobytes()  # steps until the pointer has left a character, by step and class

    def turned(self, period: int) -> bytes:
        """The class that stands for each class in a period."""
        return bytes([0, *((np.arange(255) + 101 * period) % 255 + 1).tolist()])

    def __getitem__(self, step: int) -> np.ndarray:
        return self.rows[step % PERIOD][list(self.turned(step // PERIOD))]


bits = functools.lru_cache(maxsize=1)(Bits)


@functools.lru_cache(maxsize=1)
def places() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places in characters of the text, their walk (one for all), and their step in it, in ascending order."""
    rng = np.random.default_rng(SEED + 1)
    found = [rng.permutation(32)[:EACH]]
    found += [(1 << k) + rng.choice(1 << k, EACH, replace=False) for k in range(5, SCALES + 4)]
    at = np.sort(np.concatenate(found)).astype(np.int64)
    return at, at // STRETCH, at % STRETCH * STEPS


def classes(text: str) -> np.ndarray:
    """Characters of a text as classes from 1 to 255."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint32)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes ^ (codes >> 7)) % 255 + 1).astype(np.uint8)


def leavings(known: bytes, done: np.ndarray = np.empty(0, np.int64)) -> np.ndarray:
    """The step at which the pointer has left each character of a text, given as classes; ``done`` are the steps of its
    first characters, where they are known."""
    skips, found, at = bits().skips, [done], len(done)
    period, t = divmod(int(done[-1]), PERIOD) if at else (0, 0)
    while at < len(known):
        left = []
        part = known[at : at + PERIOD]
        try:
            for c in part.translate(bits().turned(period)) if period else part:
                t += skips[t << 8 | c]
                left.append(t)
        except IndexError:  # the period has ended
            pass
        found.append(np.array(left, np.int64) + period * PERIOD)
        at, period, t = at + len(left), period + 1, 0
    return np.concatenate(found)


def walked(text: str, done: np.ndarray = np.empty(0, np.int64)) -> tuple[str, np.ndarray]:
    """A text's fingerprint (hexadecimal, two digits for each place up to the last one in the text) and its leavings."""
    at, _, step = places()
    known = classes(text)
    if not len(known):
        return "", np.empty(0, np.int64)
    left = leavings(known.tobytes(), done)
    asked = step[: np.searchsorted(at, len(known))]
    symbols = np.append(known, np.uint8(0)).astype(np.uint32)
    # Under the pointer at each step of a place: the character after those already left.
    seen = symbols[np.searchsorted(left, asked[:, None] + np.arange(SPAN), side="right")]
    value = np.zeros(len(asked), np.uint32)
    for i in range(SPAN):
        value = value * np.uint32(0x01000193) + seen[:, i]
    hashed = np.where(value > 0, ((value * np.uint32(0x9E3779B1)) >> np.uint32(24)) % 255 + 1, 0)
    return hashed.astype(np.uint8).tobytes().rstrip(b"\0").hex(), left


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of a batch of texts."""
    return [walked(x)[0] for x in texts]


@functools.lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Characters of the text for which each place stands."""
    at = places()[0]
    span = np.maximum(32, 1 << np.floor(np.log2(np.maximum(at, 1))).astype(int))
    return span / EACH


def likeness(a: str, b: str) -> float:
    """0 for texts that share no more than chance, 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(v.ljust(2 * PLACES, "0")), np.uint8) for v in (a, b))
    there = (x > 0) | (y > 0)
    w = weights()
    share = float(w[there & (x == y)].sum() / w[there].sum())
    return min(1.0, max(0.0, (share - CHANCE) / (1 - CHANCE)))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many of the first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str, rows: int, most: int = 4096) -> DataFrame:
    """Documents in descending order of ids, in ``parts`` of about ``rows`` rows (at most ``most`` parts), each part
    followed by the first document of the next one (``extra``); after the last part comes the first again."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = own.count()
    n = max(1, min(most, total // rows))
    cuts = own.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20_000)).first()[0] if total else []
    cuts = sorted(set(cuts or [])) if n > 1 else []
    # The part of a document: how many borders are at or above its id, so parts ascend as ids fall.
    borders = F.array(*map(F.lit, cuts)).cast("array<long>")
    part = F.size(F.filter(borders, lambda x: x >= F.coalesce("doc_id", F.lit(-(1 << 63))))) if cuts else F.lit(0)
    placed = own.withColumn("part", part.cast("int"))
    firsts = placed.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("head"))
    firsts = written(firsts.select("part", "head.id"), "part-heads").orderBy("part").collect()  # at most ``most`` rows
    heads = [(firsts[i]["id"], firsts[i - 1]["part"], firsts[i]["part"]) for i in range(len(firsts))]
    spark = docs.sparkSession
    heads = spark.createDataFrame(heads, "head long, before int, home int") if heads else spark.createDataFrame([], "head long, before int, home int")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    joined = placed.join(F.broadcast(heads), (key == F.col("head")) & (F.col("part") == F.col("home")), "left")
    both = F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(True).alias("extra")))
    one = F.array(F.struct("part", F.lit(False).alias("extra")))
    dealt = joined.select("doc_id", "text", F.explode(F.when(F.col("head").isNotNull(), both).otherwise(one)).alias("to"))
    return dealt.select("doc_id", "text", "to.part", "to.extra")


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 1024) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both to the document's own and to the
    next document's. Texts are shuffled once."""

    def run(batches):
        # (id, text, fingerprint, part, leavings of the half that the edited text keeps) of a document whose next one is
        # still to come
        held = None
        for ids, texts, parts, extra in pieces(batches):
            walks = [(x, left[: len(text) - len(text) // 2].copy()) for text in texts for x, left in [walked(text)]]
            chain = [] if held is None else [held]
            chain += [(i, x, w[0], p, w[1]) for i, x, w, p in zip(ids, texts, walks, parts, strict=True)]
            ends = [] if held is None else [False]
            ends += extra
            rows, changed = [], []
            for (a, following), stop in zip(zip(chain, chain[1:], strict=False), ends, strict=False):
                if not stop:
                    rows.append((a, following))
                    changed.append(edited(a[1], following[1]))
            yield from as_batches(rows, changed)
            held = None if ends[-1] else chain[-1]

    def pieces(batches):
        for batch in batches:
            kept = [batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra")]
            kept[1] = [x or "" for x in kept[1]]
            at, size = 0, 0
            for i, text in enumerate(kept[1]):
                size += len(text) + 200
                if size > 3_000_000 or i + 1 == len(kept[1]):
                    yield [x[at : i + 1] for x in kept]
                    at, size = i + 1, 0

    def as_batches(rows, changed):
        import hashlib

        if not rows:
            return
        prints = [walked(text, a[4])[0] for (a, _), text in zip(rows, changed, strict=True)]
        found = [
            (a[0], len(a[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), a[2], p, likeness(a[2], p), likeness(a[2], b[2]))
            for (a, b), text, p in zip(rows, changed, prints, strict=True)
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    dealt = with_next(docs, id_col, text_col, rows)
    # Every part ends with an extra row (the next part's first document), whose own row is made in its home part.
    ordered = dealt.repartition("part").sortWithinPartitions("part", F.asc("extra"), F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def likenesses(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Likeness of one fingerprint to each of others; all as rows of as many bytes, beyond which all are 0."""
    w = weights()[: len(x)]
    there = (x > 0) | (others > 0)
    share = ((others == x) & there) @ w / np.maximum(there @ w, 1e-9)
    return np.where((others == x).all(axis=1), 1.0, np.clip((share - CHANCE) / (1 - CHANCE), 0.0, 1.0))


def lowest(threshold: float) -> np.ndarray:
    """The first band in use by the number of places of a fingerprint: bands before it have too little weight to be
    needed, and are the ones that texts with a common beginning share."""
    total = np.append(0, weights().cumsum())
    spare = 0.999 * max(0.0, 1 - BAND * (1 - CHANCE) * (1 - threshold))
    return np.searchsorted(total[::BAND], spare * total, side="right").clip(1) - 1


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint", threshold: float = 0.8,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_links (other documents linked directly) and component_id (the smallest id
    that links reach).

    Two fingerprints are candidates when they share a band: ``BAND`` sampled places in a row, or the rest at the end. No
    pair at the threshold is lost: its unequal places have at most (1 - CHANCE) * (1 - threshold) of the weight, each
    spoils one band of ``BAND`` times its weight, and ``lowest`` leaves out less than what remains (from a threshold of
    0.75 on; below, some pairs share no band).
    Every pair of a bucket is verified by its likeness, in blocks, and counts in the first band that it shares, so pairs
    never become rows; equal fingerprints are one node with its number of copies. Empty fingerprints are linked with
    their equals only. Null fingerprints link with nothing. An empty table gives no rows. The columns of ``keep`` stay."""
    own = prints.select(F.col(id_col).cast("long").alias("doc_id"), F.col(print_col).alias("print"), *keep)
    own = own.withColumns({"node": F.when(F.col("print").isNotNull(), F.xxhash64("print")), "print": F.unhex("print")})
    nodes = own.filter("node is not null").groupBy("node").agg(F.first("print").alias("print"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    nodes = written(nodes, "prints")
    at = F.sequence(F.lit(0), F.lit(PLACES // BAND - 1))
    bands = F.transform(at, lambda i: F.substring("print", i * BAND + 1, F.lit(BAND)))
    low = lowest(threshold)
    first = F.element_at(F.array(*map(F.lit, low.tolist())), F.octet_length("print") + 1)
    dealt = nodes.select("node", first.alias("low"), F.posexplode(bands).alias("band", "value")).filter("octet_length(value) > 0 and band >= low")
    dealt = dealt.select("node", "band", F.xxhash64("band", "value").alias("bucket"))  # made twice rather than written
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = dealt.join(sizes, "bucket")

    def compare(batches):
        for rows in runs(batches, ["bucket", "first", "second"]):
            raw = rows["print"].to_pylist()
            width = -(-max(map(len, raw)) // BAND) * BAND  # places beyond hold 0 in all of them
            x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in raw), np.uint8).reshape(-1, width)
            begins, ends = low[[len(v) for v in raw]], np.array([-(-len(v) // BAND) for v in raw])  # bands of each
            node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
            first, second, side = rows["first"][0].as_py(), rows["second"][0].as_py(), rows["own"].to_numpy()
            band = rows["band"][0].as_py()
            left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
            pairs = []
            for i in left.tolist():
                j = right[right > i] if first == second else right
                j = j[likenesses(x[i], x[j]) >= threshold]
                equal = (x[i] == x[j]).reshape(len(j), width // BAND, BAND).all(axis=2)
                equal &= np.arange(width // BAND) < np.minimum(ends[i], ends[j])[:, None]
                equal &= np.arange(width // BAND) >= np.maximum(begins[i], begins[j])[:, None]
                j = j[equal.argmax(axis=1) == band] if len(j) else j
                pairs.append(np.stack([np.full(len(j), i), j]))
            if pairs and len((found := np.concatenate(pairs, axis=1))[0]):
                i, j = found
                links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                linked = np.flatnonzero(links)
                yield out(node[linked], node[linked], links[linked])
                a, b = forest(len(node), i, j)
                yield out(node[a], node[b], np.zeros(len(a)))

    def out(a, b, n):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    about = nodes.select("node", "print", "copies")
    found = written(in_blocks(members, BLOCK, about).mapInArrow(compare, "a long, b long, n long"), "print-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reached = connected_components(found.filter("a != b"))
    by_node = nodes.select("node", "rep", "copies").join(counts, "node", "left").join(reached, "node", "left")
    by_node = by_node.withColumn("component", F.coalesce("component", "node"))
    smallest = by_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = by_node.join(smallest, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    by_node = written(by_node.filter("n_links > 0"), "print-components")
    joined = own.drop("print").join(sized(by_node, by_node.count()), "node", "left")
    return joined.select("doc_id", *keep, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_fingerprints(spark, sf_dir):
    chain = written(fingerprint_chain(table(spark, sf_dir, "documents")), "print-chain")
    return near_duplicates(chain, keep=tuple(chain.columns[1:]))
