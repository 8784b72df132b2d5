"""Target-distribution importance resampling: draws documents that look like a target, by hashed word runs.

Higher-order functions make each document's array of buckets, which is stored once. Bucket totals of raw and target texts
are counted from there (combined before the shuffle, so a task sends one number for each bucket at most), and become an
array of gains of bounded length, a literal of the plan. A document's weight is then an aggregate over its own array:
scoring neither explodes nor joins. Ranks come from a range partitioning of (score, id) and the sizes of its partitions.

A null text has no words, nor has one of separators only: no features, weight 0. A null id has a null score and is never
drawn; repeated rows and ids are scored and drawn one by one, ties in any order. Without raw or target rows
the counts are 0, and without rows of both kinds every gain follows from the smoothing alone. Very long texts are one array
of small integers. Clashing column names do no harm: only the id and the text are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import table, written

BUCKETS = 10_000
#: What parts words: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, all else as it is. Where all is ASCII, ``lower`` does the same at a fraction of the time."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def runs_of(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` consecutive words, joined by a blank."""
    runs = [words]
    for n in range(2, most + 1):
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(at, _joined(words, n)))
    return F.concat(*runs) if most > 1 else words


def _joined(words: Column, n: int):
    """The ``n`` words from a place on, as a function of the place."""
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def bucketed(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, most: int = 1) -> DataFrame:
    """Rows (key, n_words, buckets): the bucket of every run of words, by crc32 of its UTF-8 bytes."""
    rows = docs.select(F.col(id_col).alias("key"), F.transform(words_of(F.col(text_col)), ascii_lower).alias("words"))
    held = F.transform(runs_of(F.col("words"), most), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))
    return rows.select("key", F.size("words").alias("n_words"), held.alias("buckets"))


def totals(rows: DataFrame) -> DataFrame:
    """How often each bucket occurs: rows (bucket, n)."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A thousand times the logarithm of each bucket's smoothed share in the target over that in the raw texts, rounded
    down. One row for each bucket is collected, whatever the input's size."""
    spark = raw.sparkSession
    both = totals(raw).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(totals(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), *[F.lit(0).cast("long").alias(n) for n in "st"])
    counts = both.unionByName(every).groupBy("bucket").agg(*[F.sum(n).cast("double").alias(n) for n in "st"])
    every = Window.partitionBy()  # one row for each bucket
    share = (F.col("t") + 1) * (F.sum("s").over(every) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(every) + buckets))
    found = counts.select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()
    return [gain for _, gain in sorted(map(tuple, found))]


def noise(key: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate of the id, rounded down: the highest of weight + noise are a draw without
    replacement in proportion to the weights."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(rows: DataFrame, gain: list[int]) -> DataFrame:
    """The rows with ``weight``, the sum of their buckets' gains."""
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folds to one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(array, b + 1))
    return rows.withColumn("weight", weight)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers rows from 1 in an order, without one task that sees all: range partitions are sorted and stored with each
    row's place, and the sizes of the partitions before (a row for each) are added."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranks")
    parts = held.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", before.alias("_before"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    held = held.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(starts), "_part")
    return held.withColumn(name, F.col("_before") + place + 1).drop("_place", "_part", "_before")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", seed: int = 2024,
    percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, most: int = 1,
) -> DataFrame:
    """Every document with n_features, weight, score and rank; rank is null for those that are not drawn. Of the documents
    with at least ``least_words`` words, ``percent`` per cent are drawn: the highest scores, ties to the smaller id."""
    rows = written(bucketed(docs, id_col, text_col, buckets, most), "buckets")
    gain = gains(rows, bucketed(target.withColumn("_none", F.lit(0)), "_none", target_text, buckets, most), buckets)
    scored = weighed(rows, gain).select(
        "key", "weight", F.size("buckets").cast("long").alias("n_features"), (F.col("weight") + noise(F.col("key"), seed)).alias("score"),
        ((F.col("n_words") >= least_words) & F.col("key").isNotNull()).alias("eligible"),
    )
    n = rows.filter((F.col("n_words") >= least_words) & F.col("key").isNotNull()).count()
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("key").asc()]
    drawn = F.when(F.col("eligible") & (F.col("rank") <= percent * n // 100), F.col("rank"))
    return ranked(scored, order).select(F.col("key").alias(id_col), "n_features", "weight", "score", drawn.alias("rank"))


def op12_importance(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH crc AS (
  SELECT list(t ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
    FROM range(256) r(i))),
docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
d AS (SELECT doc_id, unnest(words) AS word FROM docs),
b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda i:
      (instr('0123456789ABCDEF', substr(hex(encode(word)), (2 * i + 1)::BIGINT, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(word)), (2 * i + 2)::BIGINT, 1)) - 1)),
    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM d UNION SELECT word FROM b), crc),
s AS (SELECT bucket, count(*) AS n FROM d JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM d JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(words) >= 20 AS eligible,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN eligible AND place <= 10 * (SELECT count(*) FROM scored WHERE eligible) // 100 THEN place END AS rank
FROM numbered
"""
