"""The corpus pipeline and the registered queries on the smallest tables."""

import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemill.llm import ngram_join, quality, token_ids
from tidemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __x int, node long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with labels, and documents with nulls, repeated rows and clashing columns."""
    path = tmp_path_factory.mktemp("odd")
    rng = random.Random(3)
    parts = {"aa": ("bado", "kelo", "mina", "suri", "tavo"), "bb": ("zwink", "grunz", "plork", "schrub", "knirf")}
    rows, labels = [], []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        words = [rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(60)]
        bad = i % 8 >= 6
        rows.append((i, " ".join(f"{w.upper()}$$$" for w in words) if bad else " ".join(words) + ".", lang, None, None, "s", 1, 2))
        labels.append((i, int(not bad)))
    rows += [(200, rows[1][1], None, "src", 3, None, None, None), (201, rows[1][1] + " extra", "aa", None, None, None, None, None)]
    rows += [(1, rows[1][1], "aa", None, None, "s", 1, 2), (300, None, None, None, None, None, None, None), (301, "", None, None, None, None, None, None), (None, rows[3][1], None, None, None, None, None, None)]
    rows += [(302, "123 456 !!", None, None, None, None, None, None), (303, rows[5][1] * 400, "aa", None, None, None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path), docs, rows


def test_stage_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_documents(spark, odd):
    path, docs, rows = odd
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, path)
        assert after.columns == docs.columns
        kept = [r["doc_id"] for r in after.collect()]
        if name == "quality":
            bad = {i for i in range(160) if i % 8 >= 6}
            assert not bad & set(kept) and set(range(160)) - bad <= set(kept)
        if name == "language":
            assert not {300, 301, 302} & set(kept) and 303 in kept
        if name == "near_duplicates":
            assert kept.count(1) == 1 and 200 not in kept and 201 not in kept and None in kept
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, path).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)


def test_stages_on_no_documents(spark, odd):
    path, docs, _ = odd
    before = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, path)
        assert before.count() == 0


def test_run_equals_brute_force(spark, odd):
    """Packs exactly the documents that its own earlier stages keep, with a brute-force choice among near copies."""
    path, docs, _ = odd
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, path)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None]
    sets = [set(ngram_join.shingles(t or "", 5).tolist()) for _, t in rows]
    best = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and best[rows[a][0]] != best[rows[b][0]]:
                    best[rows[a][0]] = best[rows[b][0]] = min(best[rows[a][0]], best[rows[b][0]])
                    changed = True
    found = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in found if r["doc_id"] is not None} == {i for i in best if best[i] == i}
    text = dict(rows)
    own = token_ids.encoder(token_ids.default_vocabulary())
    for r in found:
        if r["doc_id"] is not None and r["start"] == 0:
            ids = np.append(np.frombuffer(next(own.encode([text[r["doc_id"]] or ""])), "<u4"), np.uint32(1)).astype("<u4")
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[: r["length"]].tobytes())


def test_statistics_of_odd_texts():
    for text in ("", " ", "\n\n", "a", "é" * 1000, "x" * 500000, "\0", "1 2 3"):
        found = quality.statistics(text)
        assert len(found) == quality.FEATURES and np.isfinite(found).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    df = QUERIES[name](spark, SF)
    table, key = {"op5": ("embeddings", "vec_id"), "op7": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    found = sorted({r[0] for r in df.select(key).collect()})
    assert found == ids and re.match(r"op\d+_", name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op2_language"](spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    rows = QUERIES["op4_quality"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_beats_a_constant(spark):
    """On tables that are large enough for trees: better than the commoner label, and good labels rank above bad ones."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op4_quality"](spark, sf).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    truth, score = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    most = max(truth.mean(), 1 - truth.mean())
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > most + 0.05
    above = (score[truth == 1][:, None] > score[truth == 0]).mean() + 0.5 * (score[truth == 1][:, None] == score[truth == 0]).mean()
    assert above > 0.9
