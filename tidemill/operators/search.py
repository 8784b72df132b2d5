"""Parameter grids, stability, folds and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import div

#: Trades of a list that is resampled: 16 MB, sent to every task.
MOST_RESULTS = 2_000_000


def grid(spark: SparkSession, values: dict[str, list[float]]) -> DataFrame:
    """All combinations of a few parameter values, with an id made of them."""
    rows = spark.range(1).drop("id")
    for name, options in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in options])))
    return rows.withColumn("candidate", F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in values]))


def random_grid(spark: SparkSession, values: dict[str, list[float]], count: int, seed: int) -> DataFrame:
    """A repeatable random choice of ``count`` of the combinations (all, if there are fewer)."""
    return grid(spark, values).orderBy(F.xxhash64(F.lit(seed), "candidate"), "candidate").limit(count)


def neighbour_stability(candidates: DataFrame, params: list[str], steps: dict[str, float], score: str = "score", share: float = 0.8) -> DataFrame:
    """For each candidate of a regular grid: its neighbours (one step in one parameter), their mean score, and how many
    reach ``share`` of its own. Each candidate is dealt to its possible neighbours' places: a join by equality."""
    moves = [(p, s) for p in params for s in (-steps[p], steps[p])]
    places = [F.struct(*[F.round(F.col(q) + (s if q == p else 0.0), 9).alias(q) for q in params]) for p, s in moves]
    dealt = candidates.select(F.col("candidate"), F.col(score).alias("_own"), F.explode(F.array(*places)).alias("_at"))
    others = candidates.select(F.struct(*[F.round(F.col(q), 9).alias(q) for q in params]).alias("_at"), F.col(score).alias("_other"))
    found = dealt.join(others, "_at").groupBy("candidate").agg(
        F.count("*").alias("neighbours"), F.avg("_other").alias("mean_neighbour"), F.count(F.when(F.col("_other") >= share * F.col("_own"), 1)).alias("holding"),
    )
    joined = candidates.join(found, "candidate", "left").na.fill(0, ["neighbours", "holding"])
    return joined.withColumn("stability", div(F.col("holding") * 1.0, F.col("neighbours")))


def select_candidate(candidates: DataFrame, groups: list[str], order: list) -> DataFrame:
    """The first candidate of each group in a total order."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return candidates.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def folds(spark: SparkSession, start: str, end: str, train_months: int, test_months: int, anchored: bool = False) -> DataFrame:
    """Walk-forward folds: half-open train and test ranges that step by the test length and end by ``end`` (dates). The
    table has a row for each ``test_months`` of the range."""
    (y0, m0), (y1, m1) = (map(int, str(x).split("-")[:2]) for x in (start, end))
    most = max(0, ((y1 - y0) * 12 + m1 - m0) // test_months + 1)
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    many = spark.range(most).select(F.col("id").alias("fold"))
    shift = F.make_ym_interval(F.lit(0), (F.col("fold") * test_months).cast("int"))
    begin = first if anchored else first + shift
    split = first + shift + F.make_ym_interval(F.lit(0), F.lit(train_months))
    rows = many.select("fold", begin.alias("train_start"), split.alias("train_end"), (split + F.make_ym_interval(F.lit(0), F.lit(test_months))).alias("test_end"))
    return rows.filter(F.col("test_end") <= last)


def by_fold(rows: DataFrame, fold_table: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the folds that they belong to, and their role there. Folds are dealt to the calendar months they touch and meet
    rows there by equality; Spark broadcasts them if they are small."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    dealt = fold_table.withColumn("_month", F.explode(F.sequence(month("train_start"), month("test_end"))))
    joined = rows.withColumn("_month", month(ts)).join(dealt, "_month").filter((F.col(ts) >= F.col("train_start")) & (F.col(ts) < F.col("test_end"))).drop("_month")
    return joined.withColumn("role", F.when(F.col(ts) < F.col("train_end"), "train").otherwise("test"))


def leakage(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Folds' last training and first test times, and whether training ends first."""
    found = rows.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col(ts))).alias("last_train"), F.min(F.when(F.col("role") == "test", F.col(ts))).alias("first_test"))
    return found.withColumn("clean", F.col("last_train") < F.col("first_test"))


def bootstrap(spark: SparkSession, results: list[float], paths: int, block: int = 1, seed: int = 7, permute: bool = False, ruin: float = 0.5, fraction: float = 0.01, circular: bool = False) -> DataFrame:
    """Metrics of resampled result paths: permutations, independent draws (block 1) or moving blocks, which
    wrap around the end if ``circular``. Paths are dealt to tasks; each has a random stream of its own, so results do not
    depend on how they are dealt. ``results`` is one whole trade list of at most ``MOST_RESULTS`` trades; more raise an error."""
    if len(results) > MOST_RESULTS:
        raise ValueError(f"{len(results)} results: more than {MOST_RESULTS}")
    own = np.asarray(results, float)
    n = len(own)

    def run(batches):
        for pdf in batches:
            rows = []
            for sim in pdf["id"].tolist():
                rng = np.random.default_rng([seed, sim])
                if permute:
                    path = rng.permutation(own)
                elif block <= 1:
                    path = own[rng.integers(0, n, n)]
                else:
                    starts = rng.integers(0, n if circular else n - block + 1, -(-n // block))
                    path = own[(starts[:, None] + np.arange(block)).ravel()[:n] % n]
                curve = np.concatenate([[0.0], path.cumsum()])
                drop = float((np.maximum.accumulate(curve) - curve).max())
                with np.errstate(divide="ignore"):
                    equity = np.log(np.maximum(0, 1 + fraction * path)).cumsum()
                breaks = np.flatnonzero(np.concatenate([[True], path >= 0, [True]]))
                longest = int(np.diff(breaks).max()) - 1
                rows.append((sim, float(curve[-1]), drop, longest, bool((equity <= np.log(1 - ruin)).any())))
            yield pd.DataFrame(rows, columns=["sim", "terminal_r", "max_drawdown_r", "losing_streak", "ruined"])

    schema = "sim long, terminal_r double, max_drawdown_r double, losing_streak long, ruined boolean"
    return spark.range(paths).mapInPandas(run, schema)


def path_summary(paths: DataFrame) -> DataFrame:
    """Distribution of path metrics."""
    return paths.agg(
        F.count("*").alias("paths"), F.percentile("terminal_r", 0.5).alias("median_terminal"), F.percentile("max_drawdown_r", 0.95).alias("p95_drawdown"),
        F.max("losing_streak").alias("worst_streak"), F.avg(F.col("ruined").cast("double")).alias("ruin"),
    )
