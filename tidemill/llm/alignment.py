"""Cross-tokenizer alignment by segment deduplication: which tokens of two vocabularies cover the same bytes.

Texts are cut into segments before white-space runs, at those characters where both vocabularies show that no token can
reach across (``safe_cuts``). So a segment has the same tokens wherever it stands. Three steps:

1. Documents are taken in slices of bounded bytes. A slice's distinct segments are numbered by Arrow, and each document
   becomes its numbers. The table of both is written once.
2. The slices' segments are shuffled by the segment, so that all slices' rows of one segment stand together: it is
   tokenized by both tokenizers and aligned once, and the alignment is joined back to each slice that asked for it.
3. Documents are composed from their segments' alignments, slice by slice, twice: first to count in how many documents each
   pair of ids is linked (a slice sends one row for each of its pairs), then, with those counts, for the results.

Every key is bounded: a segment has a row for each slice at most, a pair likewise, and a slice has its own bytes. Nothing is
broadcast, and no row is made for a link of a document.

A null or empty text, and one that a vocabulary does not give back byte by byte, has no tokens: zeros and an empty string.
Repeated rows and ids are documents of their own, a null id stays null. A very long text is a slice of its own. An empty
table gives no rows. Only the id and the text are read, so other columns' names do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.blocks import runs
from tidemill.llm.common import parts_of, plain, table, written

#: Bytes of text in a slice, and links that are looked at together.
SLICE, LINKS = 16_000_000, 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones stand for themselves, the others
    are numbered from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def safe_cuts(first: list[bytes], second: list[bytes], candidates: str = " \n\t\r") -> str:
    """The white-space characters before which a text may be cut after a character that is none: no token of either
    vocabulary has such a character behind anything but white space (a part of a character counts as none). The second
    vocabulary's tokenizer puts a blank before a text, so none of its tokens may hold a character other than the blank
    beside other bytes at all."""

    def reaches(token: bytes, c: str) -> bool:
        return any(i and not token[:i].decode(errors="replace")[-1].isspace() for i, b in enumerate(token) if b == ord(c))

    found = ""
    for c in candidates:
        alone = c == " " or not any(c.encode() in x and len(x) > 1 for x in second)
        if alone and not any(c.encode() in x and reaches(x, c) for x in [*first, *second]):
            found += c
    return found


class Pair:
    """Two tokenizers: a file of the tokenizers library with a byte-level vocabulary, and a sentencepiece model that puts a
    blank before texts. Both see a blank before every text."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = byte_alphabet()
        with open(first, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.blank = self.b.piece_to_id("▁")
        # special tokens' strings are plain text, so they never come out of a text
        ordinary = [x for i, x in enumerate(self.b_bytes) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = safe_cuts([x for i, x in enumerate(self.a_bytes) if not self._added(i)], ordinary)
        self._at = re.compile(rf"(?<=\S)(?=[{re.escape(self.cuts)}])") if self.cuts else None

    def _added(self, i: int) -> bool:
        return i in self.a.get_added_tokens_decoder()

    def segments(self, text: str) -> list[str]:
        """The segments of a blank and the text; none of an empty text."""
        return [] if not text else self._at.split(" " + text) if self._at else [" " + text]

    def marked(self, text: str) -> str | None:
        """The segments with a NUL between them, where that is simple: all white space is single, between characters."""
        if not text or " " not in self.cuts or not plain(text):
            return None
        text = text.replace(" ", "\0 ")
        return " " + (text.replace("\n", "\0\n") if "\n" in self.cuts else text)

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Each segment's ids in both vocabularies. The second tokenizer's own blank is the one that the segment begins
        with, or is taken away again."""
        first = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        second = self.b.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        second = [y if x[0] == " " and len(x) > 1 else [self.blank] if x == " " else y[1:] for x, y in zip(segments, second, strict=True)]
        return first, second

    def align(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """For each segment the number of ids in the first vocabulary, all of these, the same of the second, and the same of
        its alignment, a step for each link: 1 where the first vocabulary's token ends with it, 2 where the second's
        does, 3 where both do (which ends a group). A segment that a vocabulary does not give back has none of them."""
        first, second = self.ids(segments)
        raw = [x.encode() for x in segments]
        right = np.array([
            b"".join(map(self.a_bytes.__getitem__, a)) == x and b"".join(map(self.b_bytes.__getitem__, b)) == x
            for x, a, b in zip(raw, first, second, strict=True)
        ], bool)
        first = [x if ok else [] for x, ok in zip(first, right.tolist(), strict=True)]
        second = [x if ok else [] for x, ok in zip(second, right.tolist(), strict=True)]
        a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (first, second))
        a_end, b_end = _lengths(self, "a")[a].cumsum(), _lengths(self, "b")[b].cumsum()
        end = (np.fromiter(map(len, raw), np.int64, len(raw)) * right).cumsum()
        # both cover the same bytes, so between two ends of tokens there is one token of each
        every = np.union1d(a_end, b_end)
        ends = (x[np.searchsorted(x, every)] == every if len(x) else np.zeros(0, bool) for x in (a_end, b_end))
        steps = (next(ends) * 1 + next(ends) * 2).astype(np.uint8)
        n = [np.fromiter(map(len, x), np.int64, len(raw)) for x in (first, second)]
        at = np.append(0, np.searchsorted(every, end, side="right"))
        return n[0], a, n[1], b, np.diff(at), steps


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32 in one compressed value: their lengths, then their bytes, all lowest bytes first."""
    planes = b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays)
    return np.array(list(map(len, arrays)), "<u4").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(value: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` arrays of a packed value."""
    sizes = np.frombuffer(value[: 4 * n], "<u4").tolist()
    raw, at, found = np.frombuffer(pa.decompress(value[4 * n :], 4 * sum(sizes), codec="zstd"), np.uint8), 0, []
    for size in sizes:
        found.append(raw[at : at + 4 * size].reshape(4, size).T.copy().view("<u4").ravel())
        at += 4 * size
    return found


def gathered(items: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` items from each start on, in a row."""
    return items[np.arange(n.sum()) + np.repeat(start - (n.cumsum() - n), n)]


class Segments:
    """The alignments of a slice's segments, in order of their numbers."""

    def __init__(self, rows: pa.Table):
        parts = [unpack(x, 7) for x in rows["packed"].to_pylist()] or [[np.zeros(0, np.uint32)] * 7]
        no, *columns = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        order = np.argsort(no)
        (self.a, self.a_n), (self.b, self.b_n), (self.steps, n) = (
            (gathered(items, (size.cumsum() - size)[order], size[order]), size[order]) for size, items in zip(columns[::2], columns[1::2], strict=True)
        )
        self.at, self.bad = np.append(0, n.cumsum()), n == 0
        self.a_upto, self.b_upto = ((self.steps & k > 0).cumsum() for k in (1, 2))

    def links(self) -> np.ndarray:
        """Each link as a number: the first vocabulary's id, and the second's in the lower 32 bits."""
        a, b = self.a_upto - (self.steps & 1), self.b_upto - (self.steps >> 1)
        return self.a[a] << 32 | self.b[b]

    def groups(self) -> tuple[pa.Array, np.ndarray]:
        """Each segment's groups as text, and their number."""
        ends = np.flatnonzero(self.steps == 3)
        sides = []
        for ids, upto in ((self.a, self.a_upto), (self.b, self.b_upto)):
            borders = pa.array(np.append(0, upto[ends]), pa.int32())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(borders, pa.array(ids).cast(pa.string())), ","))
        at = np.searchsorted(ends, self.at)
        texts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pc.binary_join_element_wise(*sides, "|"))
        return pc.binary_join(texts, ";"), np.diff(at)


@functools.lru_cache(maxsize=4)
def _lengths(pair: Pair, which: str) -> np.ndarray:
    return np.fromiter(map(len, pair.a_bytes if which == "a" else pair.b_bytes), np.int64)


@functools.lru_cache(maxsize=1)
def pair_of(first: str, second: str) -> Pair:
    """A worker's tokenizers."""
    return Pair(first, second)


def numbered(pair: Pair, texts: list[str]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct segments of many texts, and the numbers of each text's segments."""
    marked = list(map(pair.marked, texts))
    odd = [[] if m is not None else pair.segments(x) for m, x in zip(marked, texts, strict=True)]
    joined = "\0".join([m for m in marked if m is not None])
    split = pc.split_pattern(pa.array([joined] if joined else [], pa.large_string()), "\0").flatten()
    coded = pa.concat_arrays([split, pa.array(list(itertools.chain.from_iterable(odd)), pa.large_string())]).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    found, at, late = [], 0, len(split)
    for m, x in zip(marked, odd, strict=True):
        n = len(x) if m is None else m.count("\0") + 1
        if m is None:
            found.append(number[late : late + n])
            late += n
        else:
            found.append(number[at : at + n])
            at += n
    return coded.dictionary, found


def sliced(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, most: int = SLICE) -> DataFrame:
    """Documents by slice: rows (slice, no, seg) for each distinct segment of a slice, the frequent ones first, and (slice,
    keys, packed) for some documents each, with how many segments they have, and the numbers of these. The other columns
    are null."""
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("seg", T.StringType()),
        T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("packed", T.BinaryType()),
    ])

    def cut(batches):
        pair, n, partition = pair_of(first, second), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in parts_of(batch, "text", most):
                name = partition << 32 | n
                n += 1
                segments, nos = numbered(pair, texts)
                key, size = part.column("key"), np.array(list(map(len, nos)), np.int64)
                every = np.concatenate(nos) if len(nos) else np.zeros(0, np.int32)
                order = np.argsort(-np.bincount(every, minlength=len(segments)), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                kind = pa.list_(key.type)
                segments = segments.take(pa.array(order))
                for at in range(0, len(segments), 50_000):
                    some = segments.slice(at, 50_000).cast(pa.string())
                    yield _batch(name, kind, no=pa.array(np.arange(at, at + len(some)), pa.int32()), seg=some)
                for lo, hi in _runs(size, 200_000):
                    own = place[every[size[:lo].sum() : size[:hi].sum()]]
                    keys = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), key.slice(lo, hi - lo))
                    yield _batch(name, kind, keys=keys.cast(kind), packed=pa.array([pack(size[lo:hi], own)], pa.binary()))

    return written(rows.mapInArrow(cut, schema), "slices")


def _runs(size: np.ndarray, most: int):
    """Runs of consecutive places whose sizes add up to about ``most``; yields (from, to)."""
    at, ends = 0, size.cumsum()
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield at, upto
        at = upto


def _batch(slice: int, kind: pa.DataType, **held: pa.Array) -> pa.RecordBatch:
    kinds = {"no": pa.int32(), "seg": pa.string(), "keys": kind, "packed": pa.binary()}
    n = len(next(iter(held.values())))
    columns = {"slice": pa.array(np.full(n, slice), pa.int64())} | {k: held[k] if k in held else pa.nulls(n, t) for k, t in kinds.items()}
    return pa.record_batch(list(columns.values()), list(columns))


ALIGNED = "slice long, packed binary"
#: Rows of segments that a task packs together.
PACKED = 400_000


def aligned(slices: DataFrame, first: str, second: str) -> DataFrame:
    """The alignments of each slice's segments. All rows of a segment stand together, so it is aligned once; what came out for
    one slice is packed into few rows."""
    rows = slices.filter("seg is not null").select("slice", "no", "seg").repartition("seg").sortWithinPartitions("seg")

    def align(batches):
        pair, last, held, n = pair_of(first, second), None, [], 0
        for batch in batches:
            coded = batch.column("seg").dictionary_encode()
            words = coded.dictionary.to_pylist()
            if not words:
                continue
            known = last is not None and last[0] == words[0]  # a segment whose rows began before
            found = pair.align(words[1:] if known else words)
            if known:
                found = tuple(np.append(x, y) for x, y in zip(last[1], found, strict=True))
            last = (words[-1], tuple(x[len(x) - (1 if i % 2 == 0 else int(found[i - 1][-1])) :] for i, x in enumerate(found)))
            held.append((batch.column("slice").to_numpy(), batch.column("no").to_numpy(), coded.indices.to_numpy(), found))
            n += len(batch)
            if n >= PACKED:
                yield from _packed(held)
                held, n = [], 0
        yield from _packed(held)

    return written(rows.mapInArrow(align, ALIGNED), "alignments")


def _packed(held: list[tuple]):
    """Rows of ``ALIGNED`` from batches of (slices, numbers, places of the alignments, alignments)."""
    if not held:
        return
    slices, no = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    lengths = [len(x[3][0]) for x in held]
    place = np.concatenate([x[2] + before for x, before in zip(held, np.cumsum([0, *lengths[:-1]]), strict=True)])
    columns = [np.concatenate([x[3][i] for x in held]) for i in range(6)]
    starts = [columns[i].cumsum() - columns[i] for i in (0, 2, 4)]
    order = np.argsort(slices, kind="stable")
    names, begin = np.unique(slices[order], return_index=True)
    for name, lo, hi in zip(names.tolist(), begin, [*begin[1:], len(order)], strict=True):
        own = order[lo:hi]
        parts = [no[own]]
        for i, start in zip((0, 2, 4), starts, strict=True):
            size = columns[i][place[own]]
            parts += [size, gathered(columns[i + 1], start[place[own]], size)]
        yield pa.record_batch([pa.array([name], pa.int64()), pa.array([pack(*parts)], pa.binary())], ["slice", "packed"])


def by_slice(kinds: list[DataFrame]) -> DataFrame:
    """Rows of several kinds, those of a slice together, a kind after the other."""
    both = [df.withColumn("kind", F.lit(i)) for i, df in enumerate(kinds)]
    every = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), both)
    return every.repartition("slice").sortWithinPartitions("slice", "kind")


def of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pc.equal(rows["kind"], kind))


PAIRS = "slice long, pair long, n long"


def pair_counts(slices: DataFrame, alignments: DataFrame) -> DataFrame:
    """In how many documents of a slice each pair of ids is linked."""
    rows = by_slice([alignments, slices.filter("packed is not null").select("slice", "packed")])

    def count(batches):
        for held in runs(batches, ["slice"]):
            segments = Segments(of_kind(held, 0))
            at, bad = segments.at, segments.bad
            pairs, local = np.unique(segments.links(), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            for packed in of_kind(held, 1)["packed"].to_pylist():
                size, nos = (x.astype(np.int64) for x in unpack(packed, 2))
                ends = size.cumsum()
                for lo, hi in _runs(size, LINKS // 4):
                    own = nos[ends[lo] - size[lo] : ends[hi - 1]]
                    n += in_docs(np.repeat(np.arange(hi - lo), size[lo:hi]), own, bad, local, at, len(pairs))
            kept = np.flatnonzero(n)
            name = held["slice"][0].as_py()
            yield pa.record_batch([pa.array(np.full(len(kept), name), pa.int64()), pa.array(pairs[kept]), pa.array(n[kept])], ["slice", "pair", "n"])

    return written(rows.mapInArrow(count, PAIRS), "pairs")


def in_docs(doc: np.ndarray, segments: np.ndarray, bad: np.ndarray, local: np.ndarray, at: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many documents (without bad segments) each pair is linked, given rows of documents and their segments."""
    keep = (np.bincount(doc, bad[segments]) == 0)[doc] if len(doc) else np.zeros(0, bool)
    held = np.unique(doc[keep] * len(bad) + segments[keep])
    doc, segments = held // max(1, len(bad)), held % max(1, len(bad))
    n = at[segments + 1] - at[segments]
    held = np.repeat(doc, n) * n_pairs + gathered(local, at[segments], n)
    held.sort()
    return np.bincount(held[np.append(True, held[1:] != held[:-1])[: len(held)]] % max(1, n_pairs), minlength=n_pairs)


def composed(slices: DataFrame, alignments: DataFrame, counts: DataFrame) -> DataFrame:
    """Each document's figures from its segments' alignments and the counts (slice, pair, n, best) of its slice's pairs."""
    docs = slices.filter("packed is not null").select("slice", "keys", "packed")
    rows = by_slice([alignments, counts, docs])
    key = T.StructField("key", docs.schema["keys"].dataType.elementType)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([key, *[T.StructField(n, T.LongType()) for n in names], T.StructField("groups_sha256", T.StringType())])

    def compose(batches):
        for held in runs(batches, ["slice"]):
            segments, pairs = Segments(of_kind(held, 0)), of_kind(held, 1).sort_by("pair")
            code, n, best = (pairs[c].to_numpy() for c in ("pair", "n", "best"))
            links = segments.links()
            place = np.searchsorted(code, links)
            there = np.append(code, -1)[place] == links  # pairs that only documents without tokens hold have no count
            place = np.where(there, place, len(code))
            sums = [np.append(0, np.append(x, 0)[place].cumsum()) for x in (best.astype(np.int64), n)]
            texts, n_groups = segments.groups()
            figures = np.stack([segments.a_n, segments.b_n, n_groups, np.diff(segments.at), *(np.diff(x[segments.at]) for x in sums)], axis=1)
            docs = of_kind(held, 2)
            del held, links, place, there, sums, pairs
            for key, packed in zip(docs["keys"].combine_chunks(), docs["packed"].to_pylist(), strict=True):
                size, nos = (x.astype(np.int64) for x in unpack(packed, 2))
                borders = np.append(0, size.cumsum())
                doc = np.repeat(np.arange(len(size)), size)
                good = (size > 0) & (np.bincount(doc, segments.bad[nos], len(size)) == 0)
                found = np.stack([np.add.reduceat(np.append(c[nos], 0), borders[:-1]) for c in figures.T], axis=1) * good[:, None]
                joined = (pc.binary_join(pa.ListArray.from_arrays(pa.array([0, q - p], pa.int32()), texts.take(pa.array(nos[p:q]))), ";")[0] for p, q in zip(borders, borders[1:], strict=False))
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(joined, good.tolist(), strict=True)]
                yield pa.record_batch([key.values, *map(pa.array, found.T.copy()), pa.array(digests, pa.string())], ["key", *names, "groups_sha256"])

    return rows.mapInArrow(compose, schema)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignment(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None, most: int = SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Each document's tokens, groups, links and their counts; and the counts themselves: rows (a, b, n, best), in how many
    documents two ids are linked, and whether no other id is linked with ``a`` in more."""
    first, second = (given or own for given, own in zip((first, second), vocabularies(), strict=True))
    slices = sliced(docs, first, second, id_col, text_col, most)
    alignments = aligned(slices, first, second)
    local = pair_counts(slices, alignments)
    total = local.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    top = total.groupBy("a").agg(F.max("n").alias("most"))
    total = written(total.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    found = composed(slices, alignments, local.select("slice", "pair").join(total, "pair"))
    counts = total.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n", "best")
    return found.withColumnRenamed("key", id_col), counts


def op13_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))[0]
