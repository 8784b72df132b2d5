"""Byte-level BPE by ranks: encoding and decoding.

Encoding looks a pre-token up in two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are
themselves vocabulary entries: a bucket's displacement gives the one slot to compare. Misses go to a merge loop over a
doubly linked list of byte runs, with a heap of (rank, position) candidates; a candidate is stale when one of its two
runs has changed. Ids of distinct text chunks are remembered within a bounded memo.

Null texts are empty and have no ids. Each match of the pattern is encoded apart; no special tokens exist. Invalid ids
raise on decoding. Repeated rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, chunks, gathered, marked_chunks, numbered_words, parts_of, table


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of distinct byte strings by hash and displacement: ``get`` costs one hash, one look at
    the bucket's displacement and one comparison."""

    def __init__(self, keys: list[bytes], values: list[int], load: int = 2):
        from xxhash import xxh3_128_intdigest

        self.hash, n = xxh3_128_intdigest, len(keys)
        self.n, self.buckets = n, max(1, n // load)
        by_bucket: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, x, step = self._parts(key)
            by_bucket.setdefault(b, []).append((x, step, i))
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        self.keys, self.values = [b""] * n, [0] * n
        lone: list[tuple[int, int]] = []
        for b, members in sorted(by_bucket.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                lone.append((b, members[0][2]))
                continue
            d = 0
            while True:
                slots = [self._slot(x, step, d) for x, step, _ in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, _, i) in zip(slots, members, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], values[i]
        free = (s for s in range(n) if not taken[s])
        for (b, i), s in zip(lone, free, strict=False):  # buckets of one key name their slot
            self.shift[b], self.keys[s], self.values[s] = -s - 1, keys[i], values[i]

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = self.hash(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFF, ((h >> 64) & 0xFFFFFFFF) | 1

    def _slot(self, x: int, step: int, d: int) -> int:
        return ((x + d * step) * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = self.hash(key)  # as in _parts and _slot, without their calls
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        slot = -d - 1 if d < 0 else (((h >> 32 & 0xFFFFFFFF) + d * (h >> 64 & 0xFFFFFFFF | 1)) * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class Bpe:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.tokens = pa.array(self.bytes_of, pa.binary())
        self.decimal = pa.array(map(str, range(len(self.bytes_of))), pa.string())
        self.words = Memo(self._word, 20_000_000)
        self.memo = Memo(self._chunk, 60_000_000)

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token by merging: lowest rank first, leftmost among equals."""
        n, ranks = len(token), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a run's end is its neighbour's start; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not 0 < j < n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(token[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(token[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def _word(self, word: str) -> bytes:
        token = word.encode("utf-8", "surrogatepass")
        rank = self.whole.get(token)
        return b"".join(map(self.packed.__getitem__, self.merge(token))) if rank is None else self.packed[rank]

    def _chunk(self, chunk: str) -> bytes:
        words = self.split.findall(chunk)
        return self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]):
        """Yields each text's ids as little-endian unsigned 32-bit integers."""
        for words, number, borders, odd in numbered_words(texts, marked_chunks, chunks):
            found = gathered(list(map(self.memo.__getitem__, words)), number, borders)
            for i, x in enumerate(found):
                yield b"".join(map(self.memo.__getitem__, odd[i])) if i in odd else x

    def decode(self, ids: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """Of each text's ids: the bytes they stand for, and the ids in decimal, joined by commas."""
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4"))
        ends = pa.array(np.cumsum([0, *map(len, ids)]) // 4, pa.int32())
        parts = (pa.ListArray.from_arrays(ends, x.take(flat)) for x in (self.tokens, self.decimal))
        decoded, text = (pc.binary_join(x, sep) for x, sep in zip(parts, (b"", ","), strict=True))
        return decoded, text


@functools.lru_cache(maxsize=2)
def _made(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def bpe(path: str, pattern: str) -> Bpe:
    """A worker's encoder for a rank file and a pattern."""
    found = _made(path, pattern)
    Memo.begin(found.words, found.memo)
    return found


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row for each document: its id and ``ids`` (little-endian unsigned 32-bit integers). One pass, no shuffle."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()

    def run(batches):
        own = bpe(path, pattern)
        for batch in batches:
            for part, items in parts_of(batch, "text", 2_000_000):
                ids = pa.array(list(own.encode(items)), pa.binary())
                yield pa.record_batch([part.column(0), ids], ["doc_id", "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds to rows of ``encode``: ``decoded`` (the bytes of the ids) and ``ids_text`` (decimal, joined by commas)."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()

    def run(batches):
        own = bpe(path, pattern)
        for batch in batches:
            kept = batch.column("ids").to_pylist()
            for lo in range(0, len(kept), 500):
                decoded, text = own.decode(kept[lo : lo + 500])
                part = batch.slice(lo, 500)
                yield part.append_column("decoded", decoded).append_column("ids_text", text)

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary, ids_text string")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op6_byte_bpe(spark, sf_dir):
    found = decode(encode(table(spark, sf_dir, "documents")))
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    hashes = F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return found.select("doc_id", n, *hashes)
