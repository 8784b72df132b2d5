"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text (byte classes, words, lines, repetition) are computed over the whole text in numpy. Training takes a
bounded sample of labelled documents, bins every statistic by quantiles and grows trees level by level from
histograms of gradients, for the logistic loss. The trees are then flattened into arrays, and a batch of documents walks
all of them at once by array indexing.

The sample: the ``most`` labelled rows of the smallest hashed ids (``TRAIN_ROWS``), and of the documents with these ids, of
which repeated ids may have several, twice as many at most; no other rows reach the driver.
Null and empty texts have statistics of 0 and get a score like any other. Repeated rows get equal scores. Without any
usable label every score is 0.5; with one class only, it is that class's rate (smoothed).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, fold, parts_of, table, unused

TRAIN_ROWS = 12_000
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n",
                             b".", b",", b"!?", b"\"'", b"|", b"#$%&*+=<>@^_~\\/", b"()[]{}", b"-:;", bytes(range(128, 256)))):
    _CLASSES[list(_chars)] = _i + 1
_N = 15
FEATURES = 27


def statistics(text: str) -> list[float]:
    """Statistics of one whole text."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * FEATURES
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(_CLASSES, weights=by_byte, minlength=_N) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    distinct = set(words)
    p = by_byte[by_byte > 0] / n
    capital = sum(map(str.isupper, words))
    odd = sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,")
    plain = sum(map(str.isalpha, words))
    longest = max(map(len, words), default=0)
    return [
        *by_class.tolist(), float(np.log1p(n)), n / m, len(distinct) / m, len(set(lines)) / k, m / k, capital / m, odd / m,
        plain / m, float(-(p * np.log(p)).sum()), float(np.log1p(longest)), len(zlib.compress(raw, 1)) / n,
        text.count("://") / m,
    ]


class Trees:
    """Flattened trees: for each node the feature, the border, the left child and the value; leaves point at themselves."""

    def __init__(self, feature, border, left, value, roots, base, depth):
        self.feature, self.border, self.left, self.value = feature, border, left, value
        self.roots, self.base, self.depth = roots, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.border[at]
            at = np.where(self.left[at] == at, at, self.left[at] + right)
        margin = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
          least: float = 5.0, l2: float = 1.0) -> Trees:
    """Gradient boosting on histograms; ``least`` is the smallest sum of second derivatives in a leaf."""
    total = len(y)
    prior = (y.sum() + 0.5) / (total + 1) if total else 0.5
    base = float(np.log(prior / (1 - prior)))
    feature, border, left, value, roots = [], [], [], [], []
    if total and 0 < y.sum() < total:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        width = x.shape[1]
        offset = np.arange(width) * bins
        margin = np.full(total, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(feature))
            feature.append(0), border.append(0.0), left.append(len(feature) - 1), value.append(0.0)
            level, node = [roots[-1]], np.full(total, roots[-1])
            for _ in range(depth):
                grown = []
                for at in level:
                    own = np.flatnonzero(node == at)
                    if len(own) < 2:
                        continue
                    keys = (binned[own] + offset).ravel()
                    hist = [np.bincount(keys, np.repeat(v[own], width), width * bins).reshape(width, bins) for v in (g, h)]
                    gl, hl = (v.cumsum(axis=1) for v in hist)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    gain[(hl < least) | (ht - hl < least)] = -1
                    for f in range(width):
                        gain[f, len(cuts[f]) :] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] <= 1e-6:
                        continue
                    feature[at], border[at], left[at] = int(f), float(cuts[f][b]), len(feature)
                    for _ in range(2):
                        feature.append(0), border.append(0.0), left.append(len(feature) - 1), value.append(0.0)
                    node[own] = left[at] + (binned[own, f] > b)
                    grown += [left[at], left[at] + 1]
                level = grown
            g_by = np.bincount(node, g, len(feature))
            h_by = np.bincount(node, h, len(feature))
            for at in np.unique(node):
                value[at] = float(rate * g_by[at] / (h_by[at] + l2))
            margin += np.array(value)[node]
    arrays = np.array(feature, np.int32), np.array(border), np.array(left, np.int32), np.array(value)
    return Trees(*arrays, np.array(roots, np.int32), base, depth)


def _measured(docs: DataFrame, keys: str) -> DataFrame:
    """Statistics of each text: the columns of ``keys`` (all but ``text``) and ``stats``."""

    def run(batches):
        for batch in batches:
            for part, items in parts_of(batch, "text"):
                stats = pa.array([statistics(x) for x in items], pa.list_(pa.float64()))
                yield part.drop_columns(["text"]).append_column("stats", stats)

    return docs.mapInArrow(run, f"{keys}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", most: int = TRAIN_ROWS) -> Trees:
    """Trains on at most ``most`` documents that have a label of 0 or 1. Documents with two labels count twice."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter("y in (0, 1) and doc_id is not null")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)  # a bounded training sample
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = chosen.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
    rows = _measured(joined, "doc_id long, y int").orderBy("doc_id", "y", "stats").limit(2 * most).toPandas()
    if not len(rows):
        return train(np.zeros((0, FEATURES)), np.zeros(0))
    return train(np.stack(rows["stats"].map(np.asarray)), rows["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of each text to the columns of ``docs`` (replacing a column of that name). No shuffle."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        Memo.begin()
        found = [trees.score(np.array([statistics(x) for x in items])) for _, items in parts_of(column)]
        return pa.array(np.concatenate([np.empty(0), *found]))

    return docs.withColumn(name, run(F.col(text_col)))


def training_fold(df: DataFrame) -> DataFrame:
    return df.filter(fold("doc_id", 5) != 0)


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(docs, training_fold(table(spark, sf_dir, "labels")))
    scored = score(docs, trees).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark, docs, sf_dir):
    """Keeps the documents that the classifier accepts; their columns stay as they are."""
    trees = fit(docs, training_fold(table(spark, sf_dir, "labels")))
    name = unused(docs, "quality_score")
    return score(docs, trees, name=name).filter(F.col(name) >= THRESHOLD).drop(name)
