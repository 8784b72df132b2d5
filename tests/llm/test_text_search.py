"""Decontamination, importance resampling and cross-tokenizer alignment against brute force."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from tidemill.llm import alignment, decontamination, importance
from tidemill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, hits int, items int, weight string, slice int, rank int"
ODD = ["a", "the", "'s", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "1", "é", "!", "<|endoftext|>", "<s>", "<0x0A>", "　", "你", "\0", "\r\n", "▁", " be", "\xa0", "ing", "É", "Z"]


def odd_texts(n, seed=7, length=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, length))) for _ in range(n)]


def table(spark, rows):
    """Documents with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, 2, None, 3, None) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- decontamination


def contaminated(docs, items, window):
    found = []
    for _, text in docs:
        own, hit, ids = words(text), set(), set()
        for name, passage in items:
            sought = words(passage)
            n = min(window, len(sought))
            runs = {tuple(sought[i : i + n]) for i in range(len(sought) - n + 1)} if n else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    ids |= {name} if name is not None else set()
        found.append((len(own), sorted(hit), sorted(ids)))
    return found


@pytest.fixture(scope="module")
def benchmark():
    rng = random.Random(11)
    vocabulary = ["ab", "cd", "ef", "É", "gh1", "你", "ij"]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    items += [("40", "one"), ("41", None), ("42", ""), ("43", " .,! "), (None, "ab cd ef gh1"), ("0", "cd cd cd ij ij"), ("44", items[3][1]), ("9", items[3][1])]
    docs = [(i, rng.choice([" ", ", ", "\n", "."]).join(rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(1, docs[1][1]), (1, docs[1][1]), (None, docs[2][1]), (200, None), (201, ""), (202, "One."), (203, "...")]
    docs += [(204, " ".join(rng.choice(vocabulary) for _ in range(5000))), (205, " ".join(f"ab{i} one" for i in range(400)))]
    return docs, items


@pytest.mark.parametrize("window,shard,block", [(4, 12_000_000, 32_000_000), (3, 200, 120), (1, 1000, 60), (50, 300, 10_000)])
def test_windows_equal_brute_force(spark, benchmark, window, shard, block):
    docs, items = benchmark
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.contamination(table(spark, docs), bench, window=window, shard=shard, block=block).collect()
    got = sorted(
        (str(r["doc_id"]), r["text"] or "", r["_n_words"], [w for h in r["_hits"] for w in range(h["first"], h["upto"])], r["_items"], r["contaminated"]) for r in found
    )
    want = sorted((str(d), t or "", n, hit, ids, bool(hit)) for (d, t), (n, hit, ids) in zip(docs, contaminated(docs, items, window), strict=True))
    assert got == want
    assert [r["n_words"] for r in found] == ["x"] * len(docs)


def test_affected_documents_go(spark, benchmark):
    docs, items = benchmark
    bench = spark.createDataFrame(items, "item_id string, text string")
    before = table(spark, docs)
    kept = decontamination.decontaminated(before, bench, window=4)
    assert kept.columns == before.columns
    want = [d for (d, _), (_, hit, _) in zip(docs, contaminated(docs, items, 4), strict=True) if not hit]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("shard", [12_000_000, 200])
def test_longest_matches_equal_brute_force(spark, benchmark, shard):
    docs, items = benchmark
    rows = {r["item_id"]: r for r in decontamination.longest_matches(table(spark, docs), spark.createDataFrame(items, "item_id string, text string"), window=3, shard=shard).collect()}
    places = collections.defaultdict(list)
    for d, t in docs:
        own = words(t)
        for j in range(len(own)):
            for n in range(1, 10):
                if j + n <= len(own):
                    places[tuple(own[j : j + n])].append((str(d) if d is not None else None, j))
    best = {}
    for name, passage in items:
        sought = words(passage)
        for i in range(len(sought) if name is not None else 0):
            for n in range(len(sought) - i, 0, -1):
                if n < 3 and not (i == 0 and n == len(sought)):
                    break
                if where := places.get(tuple(sought[i : i + n])):
                    if name not in best or (-n, i) < (-best[name][0], best[name][1]):
                        best[name] = (n, i, where)
                    break
    assert set(rows) == set(best)
    for name, (n, i, where) in best.items():
        r = rows[name]
        assert (r["n_words"], r["item_word"]) == (n, i) and (r["doc_id"], r["doc_word"]) in where


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 7, 30):
        ids = np.where(rng.random(3000) < 0.02, 0, rng.integers(1, 4, 3000))
        ids[1000:1400] = ids[100:500]
        places, _, _ = decontamination.suffix_array(ids, depth)
        padded = np.append(ids, np.zeros(depth, np.int64))
        runs = [tuple(padded[p : p + depth].tolist()) for p in places.tolist()]
        upto = [r[: r.index(0)] if 0 in r else r for r in runs]
        assert sorted(places.tolist()) == np.flatnonzero(ids).tolist() and upto == sorted(upto)


def test_no_items_and_no_documents(spark, benchmark):
    docs, items = benchmark
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.decontaminated(table(spark, docs), none).count() == len(docs)
    assert decontamination.contamination(table(spark, []), spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert decontamination.longest_matches(table(spark, docs), none).count() == 0


# --- importance resampling


def drawn(docs, target, most, buckets, percent, least, seed):
    def features(text):
        own = words(text)
        return [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]

    held = [[zlib.crc32(x.encode()) % buckets for x in features(t)] for _, t in docs]
    s, t = collections.Counter(b for x in held for b in x), collections.Counter(zlib.crc32(x.encode()) % buckets for y in target for x in features(y))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (d, text), x in zip(docs, held, strict=True):
        weight = sum(gain[b] for b in x)
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(x), weight, score, len(words(text)) >= least and d is not None))
    ranked = sorted((-r[3], r[0]) for r in rows if r[4])
    place = collections.defaultdict(list)
    for i, key in enumerate(ranked[: percent * len(ranked) // 100]):
        place[key].append(i + 1)
    return sorted((str(r[0]), *r[1:4], place[(-r[3], r[0])].pop(0) if r[4] and place[(-r[3], r[0])] else None) for r in rows)


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (3, 10_000, 100)])
def test_draw_equals_brute_force(spark, most, buckets, percent):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "É", "1", "你好", "delta"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(None, docs[0][1] * 3), (200, None), (201, ""), (202, "a b"), (203, "Beta, " * 3000), *odd_texts_rows(300)]
    target = ["alpha beta", None, "", "gamma É " * 20]
    found = importance.resampled(
        table(spark, docs), spark.createDataFrame([(x,) for x in target], "text string"), most=most, buckets=buckets, percent=percent, least_words=5
    ).collect()
    assert sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"]) for r in found) == drawn(docs, target, most, buckets, percent, 5, 2024)


def odd_texts_rows(first):
    return [(first + i, t) for i, t in enumerate(odd_texts(60, length=40))]


def test_draw_of_repeated_rows_and_of_nothing(spark):
    docs = [(1, "word " * 30)] * 20 + [(2, "other " * 30)] * 20
    found = importance.resampled(table(spark, docs), spark.createDataFrame([], "text string"), percent=50).collect()
    assert len(found) == 40 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    assert importance.resampled(table(spark, []), spark.createDataFrame([("x",)], "text string")).count() == 0


# --- alignment


def aligned(pair, rows):
    held, counts = [], collections.Counter()
    for _, text in rows:
        held.append(None)
        if not text:
            continue
        full = (" " + text).encode()
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        if b"".join(map(pair.a_bytes.__getitem__, a)) != full or b"".join(map(pair.b_bytes.__getitem__, b)) != full:
            continue
        a_end, b_end = (np.cumsum([len(of[x]) for x in ids]).tolist() for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes)))
        i = j = 0
        links, groups, ga, gb = [], [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_end[i], b_end[j]
            if x <= y:
                ga.append(str(a[i]))
                i += 1
            if y <= x:
                gb.append(str(b[j]))
                j += 1
            if x == y:
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
                ga, gb = [], []
        held[-1] = (len(a), len(b), groups, links)
        counts.update(set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    found = []
    for (d, _), x in zip(rows, held, strict=True):
        if x is None:
            found.append((str(d), 0, 0, 0, 0, 0, 0, ""))
        else:
            n_best, total = sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3])
            found.append((str(d), x[0], x[1], len(x[2]), len(x[3]), n_best, total, hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(found), counts, best


@pytest.mark.parametrize("most", [16_000_000, 300])
def test_alignment_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "LINKS", 50)
    texts = [*odd_texts(600), None, "", " ", "  ", "\n", "a ", " a", "same text", "same text", "x" * 3000, "Mixed text, in lines.\n" * 40]
    rows = [*enumerate(texts), (None, "no id"), (3, "again")]
    docs, counts = alignment.alignment(table(spark, rows), most=most)
    want, n, best = aligned(alignment.pair_of(*alignment.vocabularies()), rows)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in docs.collect()) == want
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in counts.collect()} == {p: (x, x == best[p[0]]) for p, x in n.items()}


def test_alignment_of_no_documents(spark):
    docs, counts = alignment.alignment(table(spark, []))
    assert docs.count() == 0 and counts.count() == 0


def test_cuts_are_refused_where_a_token_reaches_across():
    assert alignment.safe_cuts([b"a", b" a", b"  "], [b" a", b"  a", b"\n"], " \n") == " \n"
    assert alignment.safe_cuts([b"a b"], [b" a"], " \n") == "\n"
    assert alignment.safe_cuts([b"a"], [b"a b", b"\n\n"], " \n") == ""
    assert alignment.pair_of(*alignment.vocabularies()).cuts.startswith(" ")


# --- the registered queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in QUERIES[name](spark, SF).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in QUERIES["op13_alignment"](spark, SF).collect())
    assert found == aligned(alignment.pair_of(*alignment.vocabularies()), rows)[0]
