"""Language identification of spans.

Each word gets a score for every learned language; its script first narrows the candidates to the languages that use the
script. A Viterbi pass over the words, with a penalty for each switch, labels spans of mixed-language texts; a document's
language is the one with the most letters, and its score the share of letters it has.

The word scores are log posteriors of letter n-grams (naive Bayes), learned from a bounded sample of labelled documents:
the ``most`` rows of the smallest hashed ids (``TRAIN_DOCS``) and their ``N_GRAMS`` commonest n-grams, so the model's size
is bounded too. Null, empty and letterless texts are ``und`` with score 0 and have no spans; without any learned language
so is every text. Ties go to the language that sorts first. Repeated rows are labelled alike.
"""

from __future__ import annotations

import collections
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, fold, groups_of, parts_of, table, unused, written

TRAIN_DOCS = 4_000
N_GRAMS = 60_000
SWITCH = 12.0
LEAST = 0.5

#: First and last code points of scripts (fixed values of Unicode's blocks); other letters count as Latin.
SCRIPTS = {
    "greek": (0x0370, 0x03FF), "cyrillic": (0x0400, 0x052F), "armenian": (0x0530, 0x058F), "hebrew": (0x0590, 0x05FF),
    "arabic": (0x0600, 0x077F), "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "tamil": (0x0B80, 0x0BFF),
    "thai": (0x0E00, 0x0E7F), "georgian": (0x10A0, 0x10FF), "hangul": (0xAC00, 0xD7AF), "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF),
}


def script_of(word: str) -> str:
    """Script of a word's first letter."""
    if word.isascii():
        return "latin"
    for c in word:
        if c.isalpha():
            return next((name for name, (lo, hi) in SCRIPTS.items() if lo <= ord(c) <= hi), "latin")
    return "latin"


def letters_of(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams(letters: str) -> list[str]:
    """Bigrams and trigrams of a bordered word, and the word itself if it is short."""
    w = f"<{letters}>"
    found = [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 2] for i in range(len(w) - 1)]
    return [*found, w] if 2 < len(w) <= 7 else found


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def gram_key(gram: str) -> int:
    """A bigram or trigram as a number: 21 bits for each code point."""
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


@dataclass
class Model:
    """Learned languages, the languages of each script, and each n-gram's log probabilities."""

    langs: list[str]
    scripts: dict[str, list[int]]
    logs: dict[str, tuple[float, ...]]


class Labeller:
    """Labels texts with one model. A remembered word is its scores and its number of letters, as 32-bit floats."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch, self.k = model, switch, len(model.langs)
        self.memo = Memo(lambda word: self._scored([word])[0], 50_000_000)
        self.by_letters = Memo(lambda letters: self._rows([letters])[0], 30_000_000)
        items = sorted((gram_key(g), row) for g, row in model.logs.items() if len(g) <= 3)
        self.keys = np.array([key for key, _ in items], np.int64)
        self.logs = np.array([row for _, row in items]).reshape(len(items), self.k)
        self.blank = np.zeros(self.k + 1, np.float32).tobytes()
        ranges = sorted((lo, hi, name) for name, (lo, hi) in SCRIPTS.items())
        self.first, self.last = (np.array([r[i] for r in ranges]) for i in (0, 1))
        # For each script, and at the end for Latin: 0 for the languages that use it, a low score for others.
        self.open_to = np.full((len(ranges) + 1, self.k), -30.0)
        for i, name in enumerate([*[r[2] for r in ranges], "latin"]):
            self.open_to[i, list(model.scripts.get(name) or range(self.k))] = 0.0

    def _rows(self, words: list[str]) -> list[bytes]:
        """Rows of words of letters alone. N-grams are numbers, found in the sorted ones of the model."""
        n, logs = len(words), self.model.logs
        sizes = np.fromiter(map(len, words), np.int64, n) + 2
        codes = codes_of("".join([f"<{w}>" for w in words]))
        owner = np.repeat(np.arange(n), sizes)
        pairs = codes[:-1] << 21 | codes[1:]
        triples = codes[:-2] << 42 | pairs[1:]
        keys, own = np.concatenate([triples, pairs]), np.concatenate([owner[:-2], owner[:-1]])
        same = np.concatenate([owner[:-2] == owner[2:], owner[:-1] == owner[1:]])
        keys, own = keys[same], own[same]
        score = np.zeros((n, self.k))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            found, own = self.logs[at[hit]], own[hit]
            score = np.stack([np.bincount(own, found[:, j], n) for j in range(self.k)], axis=1)
        for i, w in enumerate(words):
            if len(w) <= 5 and (row := logs.get(f"<{w}>")) is not None:
                score[i] += row
        score /= 2
        start = codes[sizes.cumsum() - sizes + 1]
        script = np.searchsorted(self.first, start, side="right") - 1
        script = np.where((script >= 0) & (start <= self.last[script]), script, len(self.first))
        score += self.open_to[script] - score.max(axis=1, keepdims=True)
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        rows = np.column_stack([np.maximum(score, -8.0), sizes - 2]).astype(np.float32)
        raw, width = rows.tobytes(), 4 * (self.k + 1)
        return [raw[i : i + width] for i in range(0, len(raw), width)]

    def _scored(self, words: list[str]) -> list[bytes]:
        """Rows of words as they stand in texts; those of the same letters are looked up once."""
        letters = list(map(letters_of, words))
        distinct = [x for x in dict.fromkeys(letters) if x]
        known = dict(zip(distinct, self.by_letters.values_of(distinct, self._rows), strict=True))
        known[""] = self.blank
        return [known[x] for x in letters]

    def labels(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, int]]]]:
        """(language, score, spans as (first word, last word, language's place)) of each text. The new words of many
        texts are scored together."""
        if not self.k:
            return [("und", 0.0, [])] * len(texts)
        memo, found = self.memo, []
        for lo, hi in groups_of(texts):
            words = [x.split() for x in texts[lo:hi]]
            distinct = list(set().union(*words))
            known = dict(zip(distinct, memo.values_of(distinct, self._scored), strict=True))
            found += [self._label(b"".join(map(known.__getitem__, x))) for x in words]
        return found

    def label(self, text: str) -> tuple[str, float, list[tuple[int, int, int]]]:
        return self.labels([text])[0]

    def _label(self, rows: bytes) -> tuple[str, float, list[tuple[int, int, int]]]:
        found = np.frombuffer(rows, np.float32).reshape(-1, self.k + 1)
        letters = found[:, -1]
        total = float(letters.sum(dtype=np.float64))
        if not total:
            return "und", 0.0, []
        scores = found[:, :-1].astype(np.float64)
        path = self.path(scores)
        by_lang = np.bincount(path, letters, self.k)
        top = int(by_lang.argmax())
        borders = np.flatnonzero(np.diff(path)) + 1
        starts, ends = np.append(0, borders), np.append(borders, len(path)) - 1
        spans = list(zip(starts.tolist(), ends.tolist(), path[starts].tolist(), strict=True))
        return self.model.langs[top], float(by_lang[top] / total), spans

    def path(self, scores: np.ndarray) -> np.ndarray:
        """Best language of each word. The best single language is the whole path, and the loop is not needed, where no
        other path can gain on it: no stretch of words gains more by another language than a switch costs, and neither do
        the best first stretch and the best last one together (a path of r stretches in other languages has r - 1
        switches if it both begins and ends with one, r if it does either, and r + 1 otherwise)."""
        n = len(scores)
        top = int(scores.sum(axis=0).argmax())
        gain = np.vstack([np.zeros(self.k), (scores - scores[:, top : top + 1]).cumsum(axis=0)])
        ends = gain.max() + (gain[-1] - gain).max()
        if ends <= self.switch and (gain - np.minimum.accumulate(gain)).max() <= self.switch:
            return np.full(n, top)
        best, back = scores[0].tolist(), np.empty((n, self.k), np.int16)
        for i in range(1, n):
            lead = max(range(self.k), key=best.__getitem__)
            floor = best[lead] - self.switch
            row = scores[i].tolist()
            back[i] = [j if best[j] >= floor else lead for j in range(self.k)]
            best = [max(b, floor) + s for b, s in zip(best, row, strict=True)]
        path = np.empty(n, np.int64)
        path[-1] = max(range(self.k), key=best.__getitem__)
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        most: int = TRAIN_DOCS, n_grams: int = N_GRAMS) -> Model:
    """Learns from at most ``most`` documents with a language. Counting runs on Spark; only the commonest n-grams
    come to the driver."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    own = own.filter("lang is not null and text is not null and doc_id is not null")
    light = own.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(most)
    picked = own.join(F.broadcast(light.distinct()), ["doc_id", "lang"])

    def count(batches):
        for batch in batches:
            found: dict[str, collections.Counter] = collections.defaultdict(collections.Counter)
            scripts: collections.Counter = collections.Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = collections.Counter(text.split())
                for word, n in words.items():
                    if letters := letters_of(word):
                        scripts[lang, script_of(letters)] += n
                        for g in grams(letters):
                            found[lang][g] += n
            rows = [("gram", lang, g, n) for lang, c in found.items() for g, n in c.items()]
            rows += [("script", lang, s, n) for (lang, s), n in scripts.items()]
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "lang", "item", "n"])

    counted = picked.mapInArrow(count, "kind string, lang string, item string, n long")
    counted = written(counted.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    scripts = counted.filter("kind = 'script'").toPandas()
    by_gram = counted.filter("kind = 'gram'").groupBy("item").agg(F.sum("n").alias("all"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("n"))  # at most one entry for each language
    rows = by_gram.filter("all >= 2").orderBy(F.desc("all"), "item").limit(n_grams).collect()
    langs = sorted(scripts["lang"].unique())
    totals = {lang: 1.0 for lang in langs}
    for r in rows:
        for lang, n in r["n"].items():
            totals[lang] += n
    smooth = 0.5
    logs = {
        r["item"]: tuple(math.log((r["n"].get(x, 0) + smooth) / (totals[x] + smooth * len(rows))) for x in langs)
        for r in rows
    }
    shares: dict[str, list[int]] = collections.defaultdict(list)
    size = scripts.groupby("lang")["n"].sum()
    for lang, script, n in zip(scripts["lang"], scripts["item"], scripts["n"], strict=True):
        if n >= 0.01 * size[lang]:
            shares[script].append(langs.index(lang))
    return Model(langs, dict(shares), logs)


def label_spans(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``spans`` (first and last word, language) to the columns of ``docs``; columns
    of these names are replaced. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by N_GRAMS
    found = "lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"

    @F.arrow_udf(found)
    def run(column: pa.Array) -> pa.Array:
        own = labeller(sent, switch)
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", span)])
        rows = []
        for _, items in parts_of(column):
            for lang, score, spans in own.labels(items):
                rows.append((lang, score, [(a, b, model_lang(own, k)) for a, b, k in spans]))
        return pa.array([dict(zip(("lang_pred", "score", "spans"), x, strict=True)) for x in rows], kind)

    kept = docs.drop("lang_pred", "score", "spans")
    name = unused(kept, "found")
    return kept.withColumn(name, run(F.col(text_col))).select(*kept.columns, f"{name}.*")


def model_lang(own: Labeller, k: int) -> str:
    return own.model.langs[k]


_LABELLERS: dict = {}


def labeller(sent, switch: float) -> Labeller:
    """One labeller for each broadcast model in a worker, so that remembered words outlive a task."""
    key = id(sent.value), switch
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = (sent, Labeller(sent.value, switch))
    found = _LABELLERS[key][1]
    Memo.begin(found.memo, found.by_letters)
    return found


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    found = label_spans(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def language_stage(spark, docs, sf_dir):
    """Keeps documents whose main language is known and has at least ``LEAST`` of their letters."""
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    names = {c: unused(docs, f"own_{c}") for c in ("lang_pred", "score", "spans") if c in docs.columns}
    found = label_spans(docs.withColumnsRenamed(names), model)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST)).drop("lang_pred", "score", "spans")
    return found.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)
