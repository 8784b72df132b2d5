"""Benchmark decontamination by training suffix arrays: verbatim runs of words that documents share with test items.

Documents are taken in shards of bounded bytes (a shard is a slice of a task's rows). A shard's words are numbered, each
document is closed by a number below all words', and the suffixes of the whole shard are sorted: first by as many words as
fit into 63 bits, then by prefix doubling among those still equal, up to the length of the longest item. Every suffix of
every test item is then looked up by binary search, which narrows its range of the suffix array word by word. The range at
the window's length has all occurrences of that window; the last range that is not empty has the longest verbatim match and
its places. Words are compared themselves (numbered by Arrow), so nothing has to be verified afterwards.

Nothing shuffles: shards are independent, and items reach the tasks in blocks of bounded bytes, one pass for each block
(a benchmark of up to ``BLOCK`` bytes is one block). A text of over ``SHARD`` bytes is a shard of its own; its words are
sorted in pieces that overlap by the longest item.

A null or empty text, and one without words, has no words and no hits; an item without words occurs nowhere, whatever its
id. Items with one id are one item; an item with a null id marks its words, but is not among the items that are listed.
Repeated rows and document ids are judged one by one. No items, or no documents, give no hits, or no rows. All columns of
the documents are kept, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import table, unused, written

WINDOW = 10
#: Bytes of text whose suffixes are sorted together, and of items that a task holds.
SHARD, BLOCK = 12_000_000, 32_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: For each byte of UTF-8 what it counts as: letters in lower case, digits, bytes above ASCII; 0 parts words.
_AS = np.zeros(256, np.uint8)
_AS[0x80:] = np.arange(0x80, 0x100)
_AS[0x30:0x3A] = np.arange(0x30, 0x3A)
_AS[0x61:0x7B] = _AS[0x41:0x5B] = np.arange(0x61, 0x7B)


def words_in(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of an array of texts in a row, and how many each text has."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    own = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[own[0] : own[-1]] if data is not None and own[-1] > own[0] else np.zeros(0, np.uint8)
    own = own - own[0]
    low = _AS[raw]
    inside = low != 0
    border = np.ones(len(raw) + 1, bool)  # whether a word cannot go on from the byte before
    np.logical_not(inside[:-1], out=border[1:-1])
    border[own] = True
    starts = np.flatnonzero(inside & border[:-1])
    border[:-1] |= ~inside
    ends = np.flatnonzero(inside & border[1:]) + 1
    offsets = np.append(0, (ends - starts).cumsum())
    kept = low[inside]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found, np.diff(np.searchsorted(starts, own))


def bits_of(most: int) -> int:
    """Bits of numbers up to ``most``, at least one."""
    return max(1, int(most).bit_length())


def ordered(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of numbers from 0 on, ties by place. Where a row and its place fit into 64 bits they
    are sorted as one number, many times as fast as an order is found."""
    n = len(columns[0])
    sizes = [bits_of(c.max(initial=0)) for c in columns]
    place = bits_of(n)
    if sum(sizes) + place > 64:
        return np.lexsort(columns[::-1])
    packed = np.zeros(n, np.uint64)
    for c, size in zip(columns, sizes, strict=True):
        packed = packed << np.uint64(size) | c.astype(np.uint64)
    packed = packed << np.uint64(place) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << place) - 1)).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first one does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all words (``ids`` above 0; 0 closes a document), sorted by the words from there, as far as ``depth``
    words; the keys of their first words in that order; and how many words a key has."""
    bits = bits_of(ids.max(initial=0))
    width = max(1, min(depth, 2 if 2 * bits + bits_of(len(ids)) <= 64 else 1))
    padded = np.append(ids, np.zeros(width, np.int64))
    places = np.flatnonzero(ids)
    # what follows a document's end never decides: no test suffix has a 0
    keys = ids[places]
    for i in range(1, width):
        keys = keys << bits | padded[places + i]
    order = ordered([keys])
    places, keys = places[order], keys[order]
    rank = np.zeros(len(ids) + depth + 1, np.int64)
    rank[places] = np.maximum.accumulate(np.where(changes(keys), np.arange(len(keys)), 0)) + 1
    done, open_ = width, np.arange(len(places))
    while done < depth:
        head = rank[places[open_]]
        new = changes(head)
        shared = ~new
        shared[:-1] |= ~new[1:]
        open_, head = open_[shared], head[shared]
        if not len(open_):
            break
        group, there = changes(head).cumsum() - 1, places[open_]
        after = rank[there + done]
        order = ordered([group, after])
        there = there[order]
        places[open_] = there
        rank[there] = np.maximum.accumulate(np.where(changes(group, after[order]), open_, 0)) + 1
        done *= 2
    return places, keys, width


class Items:
    """Test items as words: the suffixes of all of them, with the words that are left from each place on."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        words = [WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) for _, text in rows]
        self.names = [name for name, _ in rows]
        size = np.array([len(x) for x in words], np.int64)
        number: dict[str, int] = {}
        self.words = np.array([number.setdefault(w, len(number)) for x in words for w in x], np.int64)
        self.known = pa.array([w.encode() for w in number], pa.large_binary())
        self.item = np.repeat(np.arange(len(rows)), size)
        self.at = np.arange(len(self.words)) - np.repeat(size.cumsum() - size, size)
        self.left = np.repeat(size, size) - self.at
        #: Words of the window that begins at each place: the whole item where it is shorter; 0 where none begins.
        self.window = np.where(self.left >= window, window, np.where(self.at == 0, self.left, 0))
        self.longest = int(size.max(initial=0))

    def search(self, ids: np.ndarray, mine: np.ndarray, whole: bool):
        """Looks every suffix up in the words ``ids``; ``mine`` has this shard's number of each known word (-1: none).
        Returns the places of the suffix array, and for each suffix with a window of words found: its number, the range
        of the window, the range and the words of its longest match (that of the window alone unless ``whole``)."""
        sought = np.append(mine[self.words], np.full(max(self.longest, 1), -1))
        places, keys, width = suffix_array(ids, self.longest if whole else int(self.window.max(initial=1)))
        bits = bits_of(ids.max(initial=0))
        which = np.flatnonzero((self.window > 0) & (sought[: len(self.words)] > 0))
        # the first words of each suffix, as far as a key has them
        taken = np.minimum(width, self.left[which])
        low, known = np.zeros(len(which), np.int64), np.ones(len(which), bool)
        for i in range(width):
            word = np.where(i < taken, sought[which + i], 0)
            known &= word >= 0
            low = low << bits | np.maximum(word, 0)
        high = low + (np.int64(1) << (bits * (width - taken))) - 1
        lo, hi = np.searchsorted(keys, low), np.searchsorted(keys, high, side="right")
        keep = known & (lo < hi)
        which, lo, hi, n = which[keep], lo[keep], hi[keep], taken[keep]
        shown = np.append(ids, np.zeros(self.longest + 1, np.int64))
        found = {k: [np.zeros(0, np.int64)] for k in ("which", "lo", "hi")}
        ends = {k: [np.zeros(0, np.int64)] for k in ("which", "lo", "hi", "n")}
        while len(which):
            full = n == self.window[which]
            for k, v in (("which", which), ("lo", lo), ("hi", hi)):
                found[k].append(v[full])
            more = n < (self.left[which] if whole else self.window[which])
            word = sought[which + n]
            a = _bound(shown, places, lo, hi, n, word)
            b = _bound(shown, places, lo, hi, n, word + 1)
            more &= (a < b) & (word > 0)
            stop = ~more & (n >= self.window[which])
            for k, v in (("which", which), ("lo", lo), ("hi", hi), ("n", n)):
                ends[k].append(v[stop])
            which, lo, hi, n = which[more], a[more], b[more], n[more] + 1
        return places, *({k: np.concatenate(v) for k, v in x.items()} for x in (found, ends))


def _bound(ids: np.ndarray, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each range, the first entry whose word at distance ``n`` is not below ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        below = ids[places[mid] + n[open_]] < word[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Slices of a batch whose texts have about ``most`` bytes together."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    at, ends = 0, sizes.cumsum()
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def pieces(words: np.ndarray, size: np.ndarray, most: int, overlap: int):
    """The words of a shard's texts with a 0 after each, in pieces: yields (from, ids), where ``from`` is the place of the
    piece's first entry. A shard of several texts is one piece; a long text is cut, with ``overlap`` words twice."""
    if not len(size):
        return
    ids = np.zeros(len(words) + len(size), np.int64)
    ids[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = words
    if len(size) > 1 or len(ids) <= most:
        yield 0, ids
        return
    for at in range(0, max(1, len(ids) - overlap), most):
        yield at, np.append(ids[at : at + most + overlap], 0)


def numbers(column: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's words by number, from 1; how many words each text has; the numbers of known words (-1: not there)."""
    words, size = words_in(column)
    coded = words.dictionary_encode()
    mine = pc.index_in(known, value_set=coded.dictionary) if len(coded.dictionary) else pa.nulls(len(known), pa.int32())
    mine = mine.cast(pa.int64()).fill_null(-2).to_numpy(zero_copy_only=False) + 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, size, mine


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK):
    """The items in blocks of about ``most`` bytes, by a hash of the row; a block at a time comes to the driver. Yields each
    block with whether it is the last one."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most)
    for k in range(max(1, n)):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Items(sorted(map(tuple, part.collect()), key=str), window), k >= n - 1


HITS = "array<struct<first: long, upto: long>>"


def searched(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    shard: int = SHARD, block: int = BLOCK, carried: list[str] | None = None,
) -> DataFrame:
    """Rows (doc, n_words, hits, items): the document's columns ``carried`` (None: all) as a struct, the runs of its words
    that lie in an occurrence of a window (from ``first`` on, before ``upto``), and the items with such windows."""
    kept = docs.columns if carried is None else carried
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    empty = [F.array().cast(kind).alias(name) for name, kind in (("hits", HITS), ("items", "array<string>"))]
    state = state.select("doc", "text", F.lit(None).cast("long").alias("n_words"), *empty)
    for k, (items, last) in enumerate(item_blocks(benchmark, item_id, item_text, window, block)):
        held = docs.sparkSession.sparkContext.broadcast(items)
        state = written(state, "searched") if k and k % 4 == 0 else state
        after = state.drop("text").schema if last else state.schema
        state = state.mapInArrow(_marker(held, shard, after.names), after)
    return state


def _marker(held, shard: int, names: list[str]):
    def mark(batches):
        items: Items = held.value
        for batch in batches:
            for part in slices(batch, "text", shard):
                yield marked(part, items, shard).select(names)

    return mark


def marked(part: pa.RecordBatch, items: Items, shard: int) -> pa.RecordBatch:
    """The rows of a shard with what the items' windows add to their hits and items."""
    words, size, mine = numbers(part.column("text"), items.known)
    end = (size + 1).cumsum()  # a text's words and the 0 after them
    begin = end - size - 1
    change = np.zeros(int(end[-1]) + 1 if len(end) else 1, np.int32)
    old = part.column("hits")
    row = np.repeat(np.arange(len(old)), pc.fill_null(pc.list_value_length(old), 0).to_numpy(zero_copy_only=False))
    flat = old.flatten()
    np.add.at(change, begin[row] + flat.field(0).to_numpy(), 1)
    np.add.at(change, begin[row] + flat.field(1).to_numpy(), -1)
    pairs = [np.zeros((0, 2), np.int64)]
    for at, ids in pieces(words, size, max(1, shard // 4), items.longest):
        places, found, _ = items.search(ids, mine, whole=False)
        ranges, which = np.unique(np.stack([found["lo"], found["hi"], items.window[found["which"]]], axis=1), axis=0, return_inverse=True)
        lo, size_of, n = ranges[:, 0], ranges[:, 1] - ranges[:, 0], ranges[:, 2]
        of_range = np.repeat(np.arange(len(ranges)), size_of)
        there = places[lo[of_range] + np.arange(len(of_range)) - (size_of.cumsum() - size_of)[of_range]] + at
        np.add.at(change, there, 1)
        np.add.at(change, there + n[of_range], -1)
        docs_of = np.unique(np.stack([of_range, np.searchsorted(end, there, side="right")], axis=1), axis=0)
        items_of = np.unique(np.stack([which.ravel(), items.item[found["which"]]], axis=1), axis=0)
        # each document with a window's occurrence meets each item that has the window
        borders = np.searchsorted(items_of[:, 0], np.arange(len(ranges) + 1))
        many = np.diff(borders)[docs_of[:, 0]]
        item = borders[docs_of[:, 0]].repeat(many) + np.arange(many.sum()) - (many.cumsum() - many).repeat(many)
        pairs.append(np.unique(np.stack([docs_of[:, 1].repeat(many), items_of[item, 1]], axis=1), axis=0))
    inside = np.append(0, (change.cumsum() > 0).astype(np.int8))
    edges = np.diff(inside)
    first, upto = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(end, first, side="right")
    hits = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - begin[doc], pa.int64()), pa.array(upto - begin[doc], pa.int64())], ["first", "upto"]),
    )
    listed = part.column("items").to_pylist()
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        if items.names[i] is not None:
            listed[d] = [*listed[d], items.names[i]]
    columns = {"doc": part.column("doc"), "text": part.column("text"), "n_words": pa.array(size, pa.int64()), "hits": hits, "items": pa.array(listed, pa.list_(pa.string()))}
    return pa.record_batch(list(columns.values()), list(columns))


def contamination(docs: DataFrame, benchmark: DataFrame, carried: list[str] | None = None, **how) -> DataFrame:
    """The documents' own columns (``carried``; None: all) with n_words, hits, the sorted ids of the items found, and
    whether there are hits."""
    found = searched(docs, benchmark, carried=carried, **how)
    own = found.select("doc.*")
    names = [unused(own, n) for n in ("n_words", "hits", "items", "contaminated")]
    added = ["n_words", "hits", F.array_sort(F.array_distinct("items")), F.size("hits") > 0]
    return found.select("doc.*", *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(added, names, strict=True)])


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    return searched(docs, benchmark, **how).filter(F.size("hits") == 0).select("doc.*")


MATCHES = "item_id string, item_word long, n_words long, doc_id string, doc_word long, n_places long"


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """The longest verbatim match of each item that has one of a window or more: from which word of the item on, how many
    words, where (a document and the word it begins at there; of several, the least), and at how many places. A shard
    sends one row for each item at most."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def finder(held):
        def find(batches):
            items: Items = held.value
            for batch in batches:
                for part in slices(batch, "text", shard):
                    yield _longest(part, items, shard)

        return find

    found = docs.sparkSession.createDataFrame([], MATCHES)
    for items, _ in item_blocks(benchmark, item_id, item_text, window, block):
        found = found.union(rows.mapInArrow(finder(docs.sparkSession.sparkContext.broadcast(items)), MATCHES))
    order = F.struct(-F.col("n_words"), "item_word")
    best = found.groupBy("item_id", "n_words", "item_word").agg(F.min(F.struct("doc_id", "doc_word")).alias("place"), F.sum("n_places").alias("n_places"))
    best = best.groupBy("item_id").agg(F.min_by(F.struct("item_word", "n_words", "place", "n_places"), order).alias("m"))
    return best.select("item_id", "m.item_word", "m.n_words", "m.place.doc_id", "m.place.doc_word", "m.n_places")


def _longest(part: pa.RecordBatch, items: Items, shard: int) -> pa.RecordBatch:
    words, size, mine = numbers(part.column("text"), items.known)
    end = (size + 1).cumsum()
    ids_of = part.column("doc_id").to_pylist()
    best: dict[str, tuple] = {}
    for at, ids in pieces(words, size, max(1, shard // 4), items.longest):
        places, _, ends = items.search(ids, mine, whole=True)
        for w, lo, hi, n in zip(*(ends[k].tolist() for k in ("which", "lo", "hi", "n")), strict=True):
            name, word = items.names[items.item[w]], int(items.at[w])
            if name is None or (name in best and (-best[name][0], best[name][1]) < (-n, word)):
                continue
            there = np.unique(places[lo:hi] + at)
            doc = np.searchsorted(end, there, side="right")
            where = [(ids_of[d], t - int(end[d] - size[d] - 1)) for d, t in zip(doc.tolist(), there.tolist(), strict=True)]
            if name in best and best[name][:2] == (n, word):
                where = sorted({*where, *best[name][2]}, key=str)
            best[name] = (n, word, where)
    rows = []
    for name, (n, word, where) in best.items():
        first = min(where, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        rows.append((name, word, n, first[0], first[1], len(where)))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])


def n_hit(hits: Column) -> Column:
    """Words in an array of hits."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["upto"] - h["first"])


def op11_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carried=["doc_id"])
    return found.select(
        "doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, list_slice(words, pos, pos + size - 1) AS run
  FROM (SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS pos FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, pos, size, list_slice(words, pos, pos + size - 1) AS run
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM docs, sizes WHERE len(words) >= size)),
found AS (SELECT doc_id, item_id, pos, runs.size AS size FROM runs JOIN windows USING (size, run)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
