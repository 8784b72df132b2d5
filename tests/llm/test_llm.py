"""The training-data operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemill.llm import byte_bpe, embeddings, fingerprints, language, ngram_join, packing, quality, token_counts, token_files, token_ids, warc
from tidemill.llm.blocks import forest
from tidemill.llm.common import chunks
from tidemill.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node long, spans int, part int, sig int"
ALPHABET = ["a", "the", "'s", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "1", "é", "!", "<|endoftext|>", "　", "你", "\0", "\r\n", "▁", " be"]


def odd_texts(n=400, seed=5, length=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, length))) for _ in range(n)]


def table(spark, texts, first=0):
    """Documents with extra columns whose names clash with results; nulls in every column but the id."""
    rows = [(first + i, t, None, None, None, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=("alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta", "rho", "tau")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


MIXED = [None, "", " ", "\n", "one", "one", "two words", prose(1, 300), prose(1, 300), "a" * 20000, ("é你" * 3000), prose(2, 6000), *odd_texts(40)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(token_ids.default_vocabulary())
    return lambda x: found.encode(x or "", add_special_tokens=False).ids


# --- token ids, files and packing


def test_chunked_ids_equal_the_library(library):
    texts = [*odd_texts(3000), *[x or "" for x in MIXED]]
    for text, ids in zip(texts, token_ids.encoder(token_ids.default_vocabulary()).encode(texts), strict=True):
        assert "".join(chunks(text)) == text
        assert np.frombuffer(ids, "<u4").tolist() == library(text)


def test_token_files_round_trip(spark, library):
    docs = table(spark, MIXED)
    index = token_files.with_starts(token_files.write_token_files(docs, width=64, batch_rows=4))
    rows = token_files.read_token_files(index).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(rows, MIXED, strict=True):
        ids = [*library(text), 2]
        assert row["start"] == start and np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)
    reader = token_files.ShardReader(index.first()["path"])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata


def test_token_files_of_no_documents(spark):
    index = token_files.with_starts(token_files.write_token_files(table(spark, [])))
    assert token_files.read_token_files(index).count() == 0


def test_packing(spark, library):
    rows = packing.pack(table(spark, MIXED), width=256).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    for i, text in enumerate(MIXED):
        ids, at = [*library(text), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and r["doc_tokens"] == len(ids)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_cuts(n):
    assert sum(packing.cuts(n, 256)) == n


# --- byte-level BPE


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    reference = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = [*MIXED, *odd_texts(300, 9)]
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, texts))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert np.frombuffer(row["ids"], "<u4").tolist() == reference.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()
    assert byte_bpe.encode(table(spark, [])).count() == 0


def test_byte_bpe_decodes_many_texts_at_once():
    """Arrow takes and joins all tokens of some texts; there is no Python object for each id."""
    own = byte_bpe.bpe(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    texts = ["", *[x or "" for x in MIXED], *odd_texts(50, 3), ""]
    ids = list(own.encode(texts))
    decoded, decimal = own.decode(ids)
    assert decoded.to_pylist() == [x.encode() for x in texts]
    assert decimal.to_pylist() == [",".join(map(str, np.frombuffer(x, "<u4").tolist())) for x in ids]
    assert [len(x) for x in own.decode([])] == [0, 0]
    with pytest.raises(IndexError):
        own.decode([np.array([len(own.bytes_of)], "<u4").tobytes()])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_perfect_hash(n):
    keys = [str(i).encode() for i in range(n)]
    found = byte_bpe.PerfectHash(keys, list(range(n)))
    assert [found.get(k) for k in keys] == list(range(n)) and found.get(b"none") is None
    assert len(found.keys) == n


# --- token counts


def brute_viterbi(text, pieces, unknown):
    best, count = [0.0] + [None] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if best[start] is None:
                continue
            if piece in pieces:
                score, n = pieces[piece], 1
            elif end - start == 1:
                score, n = unknown, len(piece.encode())
            else:
                continue
            if best[end] is None or best[start] + score > best[end]:
                best[end], count[end] = best[start] + score, count[start] + n
    return best[-1] or 0.0, count[-1]


def test_token_counts_equal_a_brute_viterbi():
    own = token_counts.counter(token_counts.default_vocabulary())
    pieces = token_counts.pieces_of(token_counts.default_vocabulary())
    texts = odd_texts(400, 11, 12)
    for text, score, n in zip(texts, *own.counts(texts), strict=True):
        expected = brute_viterbi("▁" + text.replace(" ", "▁"), pieces, own.unknown) if text else (0.0, 0)
        assert n == expected[1] and score == pytest.approx(expected[0])


def test_token_counts_equal_the_library_in_double_precision():
    from tokenizers import models

    pieces = token_counts.pieces_of(token_counts.default_vocabulary())
    reference = models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False)
    own = token_counts.counter(token_counts.default_vocabulary())
    texts = ["the ation there in the", "Hello world, thonere the", "a  b", "theanttion theandsh the."]
    assert own.counts(texts)[1] == [len(reference.tokenize("▁" + x.replace(" ", "▁"))) for x in texts]


def test_ties_go_to_the_longest_last_piece():
    own = token_counts.Counter({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0})
    assert own.solve("▁ab") == (-3.0, 2)


def test_token_counts_table(spark):
    rows = token_counts.token_counts(table(spark, MIXED)).orderBy("doc_id").collect()
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0 and rows[4]["n_tokens"] == rows[5]["n_tokens"] > 0
    assert token_counts.token_counts(table(spark, [])).count() == 0


# --- language


def language_docs(spark, n=160):
    rng = random.Random(8)
    parts = {"aa": ("bado", "kelo", "mina", "suri", "tavo"), "bb": ("zwink", "grunz", "plork", "schrub", "knirf")}
    texts = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        texts.append((i, " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(40)), lang))
    return spark.createDataFrame(texts, "doc_id long, text string, lang string"), parts


def test_language(spark):
    docs, parts = language_docs(spark)
    model = language.fit(docs)
    assert model.langs == ["aa", "bb"]
    found = language.label_spans(docs, model).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] == 1 for r in found)
    both = " ".join([*parts["aa"] * 8, *parts["bb"] * 12])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, both), (5, "日本"), (6, "bado " * 20000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.label_spans(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0
    assert rows[4]["lang_pred"] == "bb" and [(s["first"], s["last"], s["lang"]) for s in rows[4]["spans"]] == [(0, 39, "aa"), (40, 99, "bb")]
    assert rows[5]["lang_pred"] in ("aa", "bb") and rows[6]["lang_pred"] == "aa"


def test_language_path_equals_brute_force():
    rng = np.random.default_rng(4)
    own = language.Labeller(language.Model(["a", "b", "c"], {}, {}), 2.0)
    for _ in range(60):
        scores = rng.normal(size=(6, 3))
        path = own.path(scores)
        value = lambda p, s=scores: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(value(p) for p in np.ndindex(3, 3, 3, 3, 3, 3))
        assert value(tuple(path)) == pytest.approx(best)


def test_language_path_of_two_halves_that_share_a_switch():
    own = language.Labeller(language.Model(["a", "b", "c"], {}, {}), 12.0)
    scores = np.array([[0.0, -6.0, -2.0]] * 5 + [[-6.0, 0.0, -2.0]] * 5)
    assert own.path(scores).tolist() == [0] * 5 + [1] * 5


def test_language_without_labels(spark):
    docs = table(spark, ["some text", None])
    model = language.fit(docs)
    assert [r["lang_pred"] for r in language.label_spans(docs, model).collect()] == ["und", "und"]


# --- quality


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.train(x, y, depth=3)
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.97

    def walk(row):
        margin = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] + (row[trees.feature[at]] > trees.border[at])
            margin += trees.value[at]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])


def test_trees_without_examples():
    assert quality.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality(spark):
    good = [prose(i, 120) + "." for i in range(120)]
    bad = [" ".join(w.upper() + "$$$" for w in prose(500 + i, 120).split()) for i in range(120)]
    docs = table(spark, [*good, *bad, None, "", "x" * 100000])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 3] + [(5, None), (None, 1)], "doc_id long, quality int")
    trees = quality.fit(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, trees, name="quality_score").withColumnRenamed("score", "old").withColumnRenamed("quality_score", "score").collect()}
    assert all(rows[i] > 0.5 for i in range(120)) and all(rows[i] < 0.5 for i in range(120, 240))
    assert len(rows) == 243 and all(0 <= v <= 1 for v in rows.values())


# --- embeddings


def test_compressibility_covers_the_whole_text():
    for text in ("buy this now and win a prize today. " * 1000, prose(3, 3000), "x" * 4095 + prose(4, 2), prose(5, 40)):
        assert quality.statistics(text)[-2] == len(zlib.compress(text.encode(), 1)) / len(text.encode())
    assert quality.statistics("buy this now and win a prize today. " * 1000)[-2] < 0.02


def brute_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(np.repeat(base, 6, axis=0) + 0.04 * rng.normal(size=(240, 16)))]
    rows += [(240 + i, rows[7][1], rows[7][2]) for i in range(30)]  # equal vectors
    hot = rng.normal(size=16)
    rows += [(270 + i, (hot + 0.03 * rng.normal(size=16)).tolist(), 1) for i in range(150)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(420 + i, v, 1) for i, v in enumerate(odd)] + [(430, rows[7][1], None), (431, rows[7][1][:8], rows[7][2])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(docs).collect()}
    ids = [r[0] for r in rows]
    good = {r[0] for r in rows if r[0] < 420}
    x = np.array([r[1] for r in rows if r[0] < 420])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows if r[0] < 420])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    component = brute_components(420, zip(*np.nonzero(near), strict=True))
    for i in ids:
        n, c = (int(near[i].sum()), component[i]) if i in good else (0, i)
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (n, c, c == i)
    assert embeddings.near_duplicates(docs.filter("false")).count() == 0


def test_code_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 12))
    x = np.concatenate([x, x + 0.1 * rng.normal(size=x.shape)])
    unit = embeddings.unit_of(x)
    at = np.arange(len(x))
    i, j = embeddings.near(unit, *embeddings.codes_of(unit), 0.98, at, at, 1.0)
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    expected = brute_components(500, edges)
    links = spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: expected[x] for x in linked}
    assert connected_components(links.filter("false")).count() == 0


def test_forest():
    a, b = forest(6, np.array([0, 1, 4]), np.array([1, 2, 5]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (2, 0), (5, 4)]


# --- n-gram join


def brute_join(texts, n, num, den):
    sets = []
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset())
    edges = [(b, a) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return [len(s) for s in sets], brute_components(len(texts), edges)


def near_copies(seed, n, copies, most):
    rng = random.Random(seed)
    words = prose(seed, n).split()
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_ngram_join_equals_brute_force(spark, n, num, den):
    texts = [None, "", "one", "ONE", "One two", "one  two\t", "Äone", "äone", *near_copies(1, 150, 60, 9), *near_copies(2, 40, 40, 4), *near_copies(3, 9, 30, 1), *near_copies(4, 2000, 4, 30), *[prose(50 + i, 30) for i in range(30)]]
    texts += [texts[12]] * 25
    sizes, component = brute_join(texts, n, num, den)
    rows = ngram_join.ngram_components(table(spark, texts), n, (num, den)).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in rows] == sizes
    assert [r["component_id"] for r in rows] == component


def test_deletion_neighbours_lose_nothing():
    limit = ngram_join.Threshold(80, 100)
    rng = np.random.default_rng(3)
    for deleting in (0, 1, 2, 3):
        schemes = []
        for low, high in ngram_join.bands(limit, 200):
            need = limit.most(high, limit.largest(high)) + 1
            few = min(deleting, (need + 1) // 2)
            schemes.append(ngram_join.Scheme(low, high, few, -(-3 * max(0, need - 2 * few) // 2)))
        for _ in range(300):
            size = int(rng.integers(5, 100))
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            b = a[rng.random(size) > 0.1]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
            a = np.unique(a)
            if len(b) and limit.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert len(np.intersect1d(ngram_join.signatures(a, limit, schemes), ngram_join.signatures(b, limit, schemes)))


def test_allocation_turns_to_deletion_neighbours_when_candidates_cost_more():
    limit = ngram_join.Threshold(85, 100)
    assert ngram_join.allocate(limit, 12, 14, 1000).deleting == 0
    assert ngram_join.allocate(limit, 12, 14, 10**10).deleting > 0


def test_sketch_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, 100, dtype=np.uint64) * np.uint64(7919)) for _ in range(2))
        x, y = ngram_join.sketch(a).astype(int), ngram_join.sketch(b).astype(int)
        width = min(len(x), len(y))
        apart = np.abs(x.reshape(-1, width).sum(axis=0) - y.reshape(-1, width).sum(axis=0)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_empty_join(spark):
    assert ngram_join.ngram_components(table(spark, [])).count() == 0


def test_dedup_stage(spark):
    texts = [*near_copies(1, 100, 10, 2), "alone", None, ""]
    docs = table(spark, texts).union(table(spark, ["alone"], 10))
    kept = ngram_join.dedup_stage(spark, docs, "")
    _, component = brute_join(texts, 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(component)) and kept.columns == docs.columns


# --- fingerprints


def test_fingerprint_chain(spark):
    texts = [x for x in MIXED if x is None or len(x) < 5000]
    rows = fingerprints.fingerprint_chain(table(spark, texts), rows=7).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        text, following = texts[i] or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = fingerprints.fingerprints([text, edited, following])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, changed)
        assert r["near_edited"] == fingerprints.likeness(own, changed) and r["near_next"] == fingerprints.likeness(own, after)
    assert fingerprints.fingerprint_chain(table(spark, [])).count() == 0
    one = fingerprints.fingerprint_chain(table(spark, ["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1


def walk(text):
    """The embedding of a text and its sampled places, one step at a time."""
    at, stretch, step = fingerprints.places()
    codes, bits = fingerprints.classes(text), fingerprints.bits()
    out = np.zeros(fingerprints.PLACES, np.uint8)
    for s in range(-(-len(text) // fingerprints.STRETCH)):
        size = min(fingerprints.STRETCH, len(text) - s * fingerprints.STRETCH)
        i, seen = s * fingerprints.STRETCH, []
        for t in range(size * fingerprints.STEPS + fingerprints.SPAN):
            symbol = int(codes[i]) if i < len(text) else 0
            seen.append(symbol)
            i += int(bits[t][symbol])
        for p in np.flatnonzero((stretch == s) & (step < size * fingerprints.STEPS)):
            value = 0
            for symbol in seen[step[p] : step[p] + fingerprints.SPAN]:
                value = (value * 0x01000193 + symbol) & 0xFFFFFFFF
            out[p] = (((value * 0x9E3779B1) & 0xFFFFFFFF) >> 24) % 255 + 1 if value else 0
    return out.tobytes().rstrip(b"\0").hex()


def test_fingerprints_equal_a_plain_walk():
    texts = ["", "a", prose(1, 30), prose(2, 700), "é你" * 50]
    assert fingerprints.fingerprints(texts) == [walk(x) for x in texts]


def test_likeness_follows_edits():
    base = [prose(i, 500) for i in range(30)]
    one = [x[:1000] + "Z" + x[1001:] for x in base]
    half = [fingerprints.edited(x, y) for x, y in zip(base, base[1:] + base[:1], strict=True)]
    own, a, b = (fingerprints.fingerprints(x) for x in (base, one, half))
    mean = lambda x, y: np.mean([fingerprints.likeness(p, q) for p, q in zip(x, y, strict=True)])
    assert mean(own, a) > 0.95 and 0.35 < mean(own, b) < 0.65 and mean(own, own[1:] + own[:1]) < 0.1


def test_likeness_of_long_texts_follows_early_insertions():
    base = [prose(i, 3600) for i in range(24)]
    assert min(map(len, base)) > 20000
    own = fingerprints.fingerprints(base)
    for size, least in ((1, 0.95), (6, 0.85), (20, 0.7)):
        new = fingerprints.fingerprints([x[:50] + "Q7zk#Wv%Jx!Ym&Gp+Bd?"[:size] + x[50:] for x in base])
        assert np.mean([fingerprints.likeness(p, q) for p, q in zip(own, new, strict=True)]) > least, size


def test_fingerprints_of_long_texts_equal_a_plain_walk():
    texts = [prose(7, 6000), "ab" * 20000]
    assert fingerprints.fingerprints(texts) == [walk(x) for x in texts]


def test_near_duplicates_by_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 16)  # so that buckets are compared in several blocks
    rng = random.Random(4)
    texts = [*[prose(i, 200) for i in range(10)], prose(3, 200), prose(4, 200)[:-3] + "xyz", "", None]
    for i in range(60):  # a drifting group of near copies
        words = prose(90, 300).split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(300)] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(words[: 300 - i % 5 * 8]))
    texts += [texts[20]] * 30
    prints = fingerprints.fingerprint_chain(table(spark, texts)).select("doc_id", "fingerprint").union(spark.createDataFrame([(900, None)], "doc_id long, fingerprint string"))
    found = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in fingerprints.near_duplicates(prints).collect()}
    own = fingerprints.fingerprints([x or "" for x in texts])
    width = 2 * fingerprints.BAND
    bands = [{(i, x[i : i + width]) for i in range(0, len(x) - width + 1, width)} for x in own]
    near = [(b, a) for a in range(len(own)) for b in range(a) if (own[a] == own[b] or bands[a] & bands[b]) and fingerprints.likeness(own[a], own[b]) >= 0.8]
    degree = collections.Counter(x for pair in near for x in pair)
    component = brute_components(len(own), near)
    assert found == {i: (degree[i], component[i]) for i in range(len(own))} | {900: (0, 900)}
    assert component[10] == 3 and component[11] == 4 and component[13] == 12 and len(near) > 500
    assert fingerprints.near_duplicates(prints.filter("false")).count() == 0


def test_near_duplicates_by_fingerprint_lose_nothing(spark, tmp_path):
    rng, texts = random.Random(8), [""]
    for i in range(50):
        base = prose(i, 40)[: rng.choice([3, 6, 12, 24, 33, 50, 66, 100, 200])]
        texts.append(base)
        for _ in range(3):
            cut = len(base) - rng.randint(0, len(base) // 6)
            at = rng.randrange(cut // 2, cut)
            texts.append(base[:at] + rng.choice("#%&") + base[at + 1 : cut])
    table(spark, texts).union(table(spark, ["another text with a repeated id"], 3)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = fingerprints.op9_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    prints = [(r["doc_id"], r["fingerprint"]) for r in rows]
    near = [(a, b) for b in range(len(rows)) for a in range(b) if fingerprints.likeness(prints[a][1], prints[b][1]) >= 0.8]
    degree = collections.Counter(x for pair in near for x in pair)
    component = brute_components(len(rows), near)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[component[i]].append(r["doc_id"])
    for i, r in enumerate(rows):
        assert (r["n_links"], r["component_id"]) == (degree[i], min(least[component[i]]))
    assert len(near) > 60


# --- WARC


def test_warc_round_trip(spark):
    big = prose(1, 400)
    html = [big, big, "short", "short", None, "", "é" * 49, "é" * 50, "é" * 50, "x" * 300000, "\r\n\r\nWARC/1.1\r\n" * 20, big]
    pages = spark.createDataFrame([(i, f"http://a/{i}\n%0A", h, "c") for i, h in enumerate(html)] + [(99, None, "z" * 200, None)], "page_id long, url string, html string, path string")
    files = warc.normalise(warc.write_archives(pages.repartition(3)), drop_source=True)
    rows = {r["page_id"]: r for r in warc.read_archives(files).collect()}
    assert len(rows) == 13 and rows[3]["url"] == "http://a/3\n%0A" and rows[99]["url"] is None
    for i, h in enumerate(html):
        data = (h or "").encode()
        same = [j for j, other in enumerate(html) if (other or "") == (h or "")]
        first = min(same) if len(data) >= 100 else i
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert rows[i]["payload"] == (bytearray(data) if first == i else None)
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.filter("false")))).count() == 0


def test_normalised_members_stand_alone(tmp_path):
    records = [warc.record(i, None, b"p" * i, None) for i in range(50)]
    source, target = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    source.write_bytes(zlib.compress(b"".join(records), wbits=31))
    assert warc.normalise_file(f"file://{source}", f"file://{target}") == 50
    data = target.read_bytes()
    for line, whole in zip((tmp_path / "b.warc.gz.idx").read_text().splitlines(), records, strict=True):
        at, length, _ = line.split("\t")
        assert zlib.decompress(data[int(at) : int(at) + int(length)], wbits=31) == whole


def test_ranks_file():
    path = byte_bpe.default_ranks()
    with open(path, "rb") as f:
        first = f.readline().split()
    assert byte_bpe.read_ranks(path)[base64.b64decode(first[0])] == int(first[1])


def test_warc_rows_that_repeat_or_lack_an_id(spark):
    a, b, c = "a" * 200, "b" * 200, "c" * 200
    pages = spark.createDataFrame([(1, "u", a, 0), (2, "u", b, 0), (5, "u", a, 0), (5, "u", b, 0), (5, "u", c, 0), (None, "u", c, 0), (None, None, None, 0)], "page_id long, url string, html string, digest int")
    found = warc.read_archives(warc.normalise(warc.write_archives(pages))).collect()
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else r["payload"].decode()) for r in found)
    assert got == collections.Counter([
        (1, "response", None, a), (2, "response", None, b), (5, "revisit", 1, None), (5, "revisit", 2, None), (5, "response", None, c),
        (None, "response", None, c), (None, "response", None, ""),
    ])


def test_embeddings_that_repeat_or_lack_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], "x"), (1, [0.0, 1.0, 0.0, 0.0], "x"), (2, [1.0, 0.01, 0.0, 0.0], "x"), (3, [0.01, 1.0, 0.0, 0.0], "x"),
            (4, [0.0, 0.0, 1.0, 0.0], "x"), (None, [0.0, 0.0, 1.0, 0.01], "x"), (None, [0.0, 0.0, 0.0, 1.0], "x"), (9, [0.0, 0.0, 0.0, 1.0], None)]
    for kind in ("array<double>", "array<float>"):
        df = spark.createDataFrame([(*r, 7) for r in rows], f"vec_id long, embedding {kind}, label string, node int")
        found = embeddings.near_duplicates(df).collect()
        got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found)
        assert got == collections.Counter([
            (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (None, 1, 4, False), (None, 0, None, True), (9, 0, 9, True),
        ])


def test_dedup_stage_goes_by_id_and_text(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a, 0), (7, a, 0), (7, b, 0), (8, b, 0), (7, b, 0)], "doc_id long, text string, text_key int")
    kept = ngram_join.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (7, b)]


def test_language_with_clashing_columns_and_ties(spark):
    model = language.Model(["aa", "bb"], {"latin": [0, 1]}, {})
    docs = spark.createDataFrame([(1, "same score", 1, 2.0, "x")], "doc_id long, text string, found int, score double, spans string")
    row = language.label_spans(docs, model).first()
    assert (row["lang_pred"], row["score"], row["found"]) == ("aa", 1.0, 1)


def test_memos_forget_but_give_the_same_values():
    from tidemill.llm.common import Memo

    made = []
    memo = Memo(lambda k: made.append(k) or k.encode() * 2, 4_000)
    for i in range(300):
        assert memo["common"] == b"commoncommon" and memo[f"rare{i}"] == f"rare{i}".encode() * 2
        keys = [f"k{j}" for j in range(i % 7)]
        assert memo.values_of(keys, lambda new: [x.encode() for x in new]) == [x.encode() for x in keys]
        assert memo.bytes < 6_000 and len(memo.old) < 40
    assert made.count("common") == 1


def test_texts_with_special_strings_equal_the_library(library):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>\n\ny  z"):
        assert np.frombuffer(next(iter(token_ids.encoder(token_ids.default_vocabulary()).encode([text]))), "<u4").tolist() == library(text)
