"""Walk-forward validation: stability of parameters, bars of folds, selection in training, results in test, drift.

Tables of candidates and folds are small (a grid, a calendar); bars and trades can have any size. Bars are numbered once in
chunks, and a fold's warm-up and embargo follow from the numbers at its ends, so no window runs over a fold. Trades are sorted
once, in chunks; balances and drawdowns of each fold follow from what the chunks' curves leave.
"""

from __future__ import annotations

import functools
import itertools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import change_percent, div
from tidemill.operators.carry import chunked, numbered
from tidemill.operators.metrics import loss, profit_factor, win
from tidemill.operators.search import by_fold
from tidemill.operators.stored import stored

#: Labels of neighbourhoods from best to worst, and warnings.
CLASSES = ("Broad Plateau", "Moderate Stability", "Fragile Region", "Insufficient Neighbors")
ISOLATED, BOUNDARY, FRAGILE = "ISOLATED PEAK PATTERN", "BOUNDARY SENSITIVITY", "FRAGILITY WARNING: UNSTABLE NEIGHBORING RESULTS"
#: Faults of a fold.
ORDER_FAULT = "TRAINING DATA DOES NOT PRECEDE VALIDATION TRADE-ELIGIBLE DATA"
EMPTY_FAULT = "no validation bars remaining after embargo"

METRICS = ("total_trades", "profit_factor", "average_r", "pnl", "max_drawdown")


def stability(
    candidates: DataFrame, params: dict[str, tuple[float, float]], keys: list[str], broad: float = 75.0, moderate: float = 50.0, weights: tuple[float, float, float] = (0.4, 0.4, 0.2),
    distance: int = 1,
) -> DataFrame:
    """Adds what the neighbours of each candidate (those that differ in ``distance`` parameters at most) say of it: count, percent with
    profit and with positive R, medians and spread, a score, a class, warnings. ``params`` gives each parameter's first and last
    value; parameters are not null and combinations are unique within ``keys``.

    Candidates that agree in all parameters but ``distance`` share a place; each is dealt to its places and meets the others
    there by equality, whatever the grid. Two that differ in fewer parameters share several places, and count at the first."""
    left_out = list(itertools.combinations(params, min(distance, len(params))))
    places = F.array(*[F.concat_ws("|", F.lit(",".join(out)), *[F.col(q).cast("string") for q in params if q not in out]) for out in left_out])
    own = F.struct(*params)
    dealt = candidates.select(*keys, "candidate", own.alias("_at"), *METRICS, F.posexplode(places).alias("_n", "_line"))
    others = dealt.select(*keys, "_line", F.col("candidate").alias("_other"), F.col("_at").alias("_there"), *[F.col(m).alias(f"_{m}") for m in METRICS])
    met = dealt.select(*keys, "candidate", "_at", "_n", "_line").join(others, [*keys, "_line"]).filter("candidate <> _other")
    agree = [functools.reduce(operator.and_, [F.col("_at")[q] == F.col("_there")[q] for q in params if q not in out], F.lit(True)) for out in left_out]
    for i, same in enumerate(agree):
        met = met.filter((F.col("_n") <= i) | ~same)
    n = F.count("*")
    found = met.groupBy(*keys, "candidate").agg(
        n.alias("neighbors"), (F.count(F.when(F.col("_pnl") > 0, 1)) * 100.0 / n).alias("profitable_percent"),
        (F.count(F.when(F.col("_average_r") > 0, 1)) * 100.0 / n).alias("positive_r_percent"), F.percentile("_profit_factor", 0.5).alias("median_pf"),
        F.percentile("_average_r", 0.5).alias("median_r"), F.percentile("_max_drawdown", 0.5).alias("median_drawdown"),
        F.stddev_pop("_profit_factor").alias("pf_spread"),
    )
    rows = candidates.join(found, [*keys, "candidate"], "left").na.fill(0, ["neighbors"]).na.fill(0.0, ["pf_spread"])
    some = F.col("neighbors") > 0
    # A median drawdown of 0 counts as none, and none as 100.
    calm = 100 - F.least(F.coalesce(F.nullif("median_drawdown", F.lit(0.0)), F.lit(100.0)), F.lit(100.0))
    level = F.least("profitable_percent", "positive_r_percent")
    label = F.when(~some, CLASSES[3]).when(level >= broad, CLASSES[0]).when(level >= moderate, CLASSES[1]).otherwise(CLASSES[2])
    edge = F.lit(False)
    for p, ends in params.items():
        edge = edge | F.col(p).isin(*[float(x) for x in ends])
    warnings = F.array(
        F.when(F.col("profit_factor") > F.col("median_pf") * 1.5, ISOLATED), F.when(edge, BOUNDARY),
        F.when(F.col("median_pf").isNotNull() & (F.col("pf_spread") > F.greatest(F.abs("median_pf") * 0.5, F.lit(0.25))), FRAGILE),
    )
    score = weights[0] * F.col("profitable_percent") + weights[1] * F.col("positive_r_percent") + weights[2] * calm
    return rows.withColumns({"stability_score": F.when(some, score), "classification": label, "warnings": F.array_compact(warnings)})


def fold_bars(bars: DataFrame, folds: DataFrame, keys: list[str], embargo: int, warmup: int, ts: str = "ts") -> DataFrame:
    """Bars with each fold they belong to and their ``use`` there: train, warmup (the last ones of training), embargo (the
    first ones of the test range) or eligible. Bars are unique by key and time."""
    rows = by_fold(numbered(bars, keys, [ts], "_n"), folds, ts)
    train = F.col("role") == "train"
    ends = rows.groupBy(*keys, "fold").agg(F.max(F.when(train, F.col("_n"))).alias("_last"), F.min(F.when(~train, F.col("_n"))).alias("_first"))
    use = F.when(train & (F.col("_n") > F.col("_last") - warmup), "warmup").when(train, "train").when(F.col("_n") < F.col("_first") + embargo, "embargo").otherwise("eligible")
    return rows.join(ends, [*keys, "fold"]).withColumn("use", use).drop("_n", "_last", "_first")


def fold_integrity(used: DataFrame, keys: list[str], least_train: int, least_test: int, ts: str = "ts") -> DataFrame:
    """Counts and ends of the bars of each fold, and its fault if it has one. Folds without any bar have no row."""
    of = lambda *names: F.when(F.col("use").isin(*names), F.col(ts))
    found = used.groupBy(*keys, "fold").agg(
        F.count(of("train", "warmup")).alias("training"), F.count(of("warmup")).alias("warmup"), F.count(of("embargo", "eligible")).alias("validation"),
        F.count(of("eligible")).alias("eligible"), F.max(of("train", "warmup")).alias("training_end"), F.min(of("warmup")).alias("warmup_start"),
        F.min(of("eligible")).alias("validation_start"),
    )
    short = lambda name, least: F.concat(F.lit("has "), F.col(name).cast("string"), F.lit(f" {name} bars, requires {least}"))
    fault = F.when(F.col("training") < least_train, short("training", least_train)).when(F.col("validation") < least_test, short("validation", least_test))
    fault = fault.when(F.col("eligible") == 0, EMPTY_FAULT).when(~F.coalesce(F.col("training_end") < F.col("validation_start"), F.lit(False)), ORDER_FAULT)
    return found.withColumn("fault", fault)


@dataclass(frozen=True)
class Policy:
    """What a candidate must reach in training to be selected; None asks for nothing."""

    minimum_trades: int = 0
    maximum_drawdown: float | None = None
    minimum_profit_factor: float | None = None
    positive_r: bool = True
    avoid_isolated: bool = True

    def refusal(self) -> Column:
        """Why a candidate is refused, or null. With a limit, a drawdown of 0 counts as unknown and is refused."""
        tests = [F.when(F.col("total_trades") < self.minimum_trades, f"trades<{self.minimum_trades}")]
        if self.maximum_drawdown is not None:
            known = F.nullif("max_drawdown", F.lit(0.0))
            tests.append(F.when(known.isNull() | (known > self.maximum_drawdown), f"max_dd>{self.maximum_drawdown}"))
        if self.minimum_profit_factor is not None:
            tests.append(F.when(F.col("profit_factor").isNull() | (F.col("profit_factor") < self.minimum_profit_factor), f"pf<{self.minimum_profit_factor}"))
        if self.positive_r:
            tests.append(F.when(F.col("average_r").isNull() | (F.col("average_r") < 0), "average_r<0.0"))
        return F.nullif(F.concat_ws("; ", *tests), F.lit(""))


def _curves(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What metrics need of trades, stored: for each chunk of a series and each height of the running result within it, the least
    that the result falls to below that height, and sums. Trades are sorted once, whatever folds they belong to. Heights that the
    result doesn't fall from are one row, with the first and the highest of them: no later one tells more, as from a capital that
    isn't negative the drawdown there is 0, or, below an earlier peak, less than at the first. So a list that only rises leaves one
    row, not one for each trade."""
    rows = chunked(trades.select(*dict.fromkeys([*keys, *order, "pnl", "r"])), keys, order).withColumn("_hash", F.xxhash64("_chunk"))
    w = Window.partitionBy("_hash", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    move = F.coalesce("pnl", F.lit(0.0))
    rows = rows.withColumn("_upto", F.sum(move).over(w)).withColumn("_high", F.max("_upto").over(w))
    sums = {"_move": move, "_gain": F.when(win(), F.col("pnl")), "_lost": F.when(loss(), -F.col("pnl")), "_net": F.col("pnl"), "_r": F.col("r")}
    counts = [F.count("pnl").alias("_trades"), F.count("r").alias("_rs")]
    fallen = F.when((F.col("_upto") < F.col("_high")) | F.isnan("_upto"), F.col("_high"))
    ends = [F.min("_high").alias("_high"), F.max("_high").alias("_most"), F.min("_upto").alias("_low")]
    return stored(rows.groupBy("_hash", "_chunk", fallen.alias("_from")).agg(*ends, *counts, *[F.sum(c).alias(n) for n, c in sums.items()]))


def _rated(curves: DataFrame, keys: list[str], place: list[Column], initial: float, uses: DataFrame | None = None) -> DataFrame:
    """Metrics of each group, stored, from the curves of its chunks in the order of ``place``. ``uses`` are the folds and roles of
    each span of time, where chunks have one."""
    parts = curves.groupBy("_chunk").agg(F.sum("_move").alias("_move"), F.max("_most").alias("_top"))
    if uses is not None:
        parts = parts.withColumn("_span", F.col("_chunk")["_span"]).join(F.broadcast(uses), "_span")  # a calendar
    of = [F.col(k) if uses is not None and k in uses.columns else F.col("_chunk")[k].alias(k) for k in keys]
    parts = parts.select("_chunk", *of, "_move", "_top")
    before = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.lit(float(initial)) + F.coalesce(F.sum("_move").over(before), F.lit(0.0)))
    parts = parts.withColumn("_before", F.greatest(F.lit(float(initial)), F.max(F.col("_base") + F.col("_top")).over(before)))
    peak, most = F.greatest("_before", F.col("_base") + F.col("_high")), F.greatest("_before", F.col("_base") + F.col("_most"))
    drop = F.greatest(div((peak - F.col("_base") - F.col("_low")) * 100, peak), F.when(most > 0, F.lit(0.0)))
    none = F.lit(0.0)
    gain, lost = F.coalesce(F.sum("_gain"), none), F.coalesce(F.sum("_lost"), none)
    found = curves.join(parts.select("_chunk", *keys, "_base", "_before"), "_chunk").groupBy(*keys).agg(
        F.sum("_trades").alias("total_trades"), profit_factor(gain, lost, False).alias("profit_factor"), div(F.sum("_r"), F.sum("_rs")).alias("average_r"),
        F.sum("_net").alias("pnl"), F.max(drop).alias("max_drawdown"),
    )
    return stored(found)


def measured(trades: DataFrame, keys: list[str], order: list[str], initial: float) -> DataFrame:
    """Metrics of each group of trades: count, profit factor (null without losses), mean R, result, largest drawdown in percent."""
    return _rated(_curves(trades, keys, order), keys, [F.col("_chunk")["_at"]], initial)


def measured_by_fold(trades: DataFrame, folds: DataFrame, keys: list[str], order: list[str], initial: float, ts: str = "ts") -> DataFrame:
    """The same for each fold and role. Ends of folds cut time into spans; a trade lies in one of them, however many folds
    overlap there, and a fold's curve is put together from its spans'. Folds are few, as in ``walk_forward``."""
    spark, rows = folds.sparkSession, folds.select("fold", "train_start", "train_end", "test_end").collect()
    ends = sorted({t for r in rows for t in r[1:]})
    spans = list(enumerate(itertools.pairwise(ends)))
    table = spark.createDataFrame([(i, a, b, b) for i, (a, b) in spans], "fold long, train_start timestamp_ntz, train_end timestamp_ntz, test_end timestamp_ntz")
    used = [(r["fold"], "train" if a < r["train_end"] else "test", i) for r in rows for i, (a, _) in spans if r["train_start"] <= a < r["test_end"]]
    uses = spark.createDataFrame(used, "fold long, role string, _span long")
    placed = by_fold(trades, F.broadcast(table), ts).withColumnRenamed("fold", "_span")  # a calendar
    return _rated(_curves(placed, [*keys, "_span"], order), ["fold", "role", *keys], [F.col("_chunk")["_span"], F.col("_chunk")["_at"]], initial, uses)


def select(rated: DataFrame, keys: list[str], policy: Policy = Policy()) -> DataFrame:
    """The chosen candidate of each group, by class, score, neighbours' R, own R, profit factor, drawdown and id; candidates
    with a warning of an isolated peak only where there is no other. An aggregate, combined before the shuffle."""
    rows = rated.filter(policy.refusal().isNull())
    isolated = F.array_contains("warnings", ISOLATED).cast("int") if policy.avoid_isolated else F.lit(0)
    down = lambda name: F.coalesce(-F.col(name), F.lit(float("inf")))
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("classification"))
    order = F.struct(isolated, place, down("stability_score"), down("median_r"), down("average_r"), down("profit_factor"), F.coalesce("max_drawdown", F.lit(float("inf"))), F.col("candidate"))
    kept = [c for c in rated.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("_best")).select(*keys, "_best.*")


def walk_forward(
    trades: DataFrame, candidates: DataFrame, folds: DataFrame, params: dict[str, tuple[float, float]], order: list[str], policy: Policy = Policy(), initial: float = 10_000.0
) -> DataFrame:
    """For every fold, the candidate selected on its training trades, and how that one did on its test trades.

    ``trades`` are those of all candidates over all time; ``candidates`` (id and parameters) and ``folds`` (from
    ``search.folds``) are small. A candidate without trades in a range has 0 of them there. Folds in which the policy refuses
    every candidate are NO_SELECTION."""
    results = measured_by_fold(trades, folds, ["candidate"], order, initial)
    slots = candidates.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(max(folds.count() - 1, 0))))).withColumn("fold", F.col("fold").cast("long"))
    none = {"total_trades": 0, "average_r": 0.0, "pnl": 0.0, "max_drawdown": 0.0}
    train = stored(slots.join(results.filter("role = 'train'").drop("role"), ["fold", "candidate"], "left").na.fill(none))
    chosen = select(stability(train, params, ["fold"]), ["fold"], policy)
    test = results.filter("role = 'test'").select("fold", "candidate", *[F.col(m).alias(f"test_{m}") for m in METRICS])
    found = chosen.join(test, ["fold", "candidate"], "left").na.fill({f"test_{m}": v for m, v in none.items()})
    changes = {"profit_factor": "pf_degradation", "average_r": "average_r_degradation", "total_trades": "trade_frequency_change", "max_drawdown": "drawdown_change"}
    found = found.withColumns({f"{n}_percent": change_percent(F.col(m), F.col(f"test_{m}")) for m, n in changes.items()})
    status = F.when(F.col("candidate").isNotNull(), "SELECTED").otherwise("NO_SELECTION")
    return folds.join(found, "fold", "left").withColumn("status", status)


def selected_drift(results: DataFrame, params: list[str]) -> DataFrame:
    """How far each parameter of the selected candidates moves from one selected fold to the next."""
    rows = results.filter("status = 'SELECTED'").unpivot("fold", [F.col(p).cast("double").alias(p) for p in params], "parameter", "value")
    # Folds are few: their values make one short list for each parameter.
    path = F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"])
    found = rows.groupBy("parameter").agg(F.count("*").alias("folds"), F.count_distinct("value").alias("values"), path.alias("_path"))
    steps = F.zip_with(F.slice("_path", F.lit(2), F.greatest(F.size("_path") - 1, F.lit(0))), F.slice("_path", F.lit(1), F.greatest(F.size("_path") - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    return found.select("parameter", "folds", (F.col("values") > 1).alias("changed"), total.alias("distance"))


def validation_comparison(development: DataFrame, validation: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the same candidates on two data sets; losses in percent of the first, null where that is null or 0."""
    loss = lambda a, b: F.when(F.col(a) != 0, div(F.col(a) - F.col(b), F.abs(F.col(a))) * 100)
    both = development.select(*keys, *[F.col(m).alias(f"development_{m}") for m in METRICS]).join(validation.select(*keys, *[F.col(m).alias(f"validation_{m}") for m in METRICS]), keys)
    return both.withColumns({f"{m}_loss_percent": loss(f"development_{m}", f"validation_{m}") for m in METRICS if m != "pnl"})


def factor_trend(variants: DataFrame, keys: list[str], place: str, control: dict[str, float], original: float) -> DataFrame:
    """How results follow one factor over its tested values: plateau, monotone, isolated or none. ``control`` gives
    profit_factor and average_r of the unchanged setting. Tested values are few and make one short list for each factor."""
    better = (F.col("profit_factor") > control["profit_factor"]) & (F.col("average_r") > control["average_r"])
    row = F.struct(F.col(place).alias("at"), F.coalesce(better, F.lit(False)).alias("better"), F.col("profit_factor").alias("pf"), F.col("average_r").alias("r"))
    varied, good = F.col(place) != original, F.col(place).isNotNull() & (F.col(place) != original) & better
    found = variants.groupBy(*keys).agg(
        F.count(F.when(varied, 1)).alias("varied"), F.count(F.when(good, 1)).alias("better"), F.avg(F.when(good, F.col("low_sample").cast("double"))).alias("_low"),
        F.percentile(F.when(good, F.col("retention_percent")), 0.5).alias("_kept"), F.array_sort(F.collect_list(row)).alias("_all"),
    )
    pairs = lambda rows, test: F.zip_with(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), test)
    yes = lambda x: F.coalesce(x, F.lit(False))
    others = F.filter("_all", lambda x: x["at"] != original)
    adjacent = F.exists(pairs(others, lambda a, b: a["better"] & b["better"]), lambda x: x)
    rising = F.forall(pairs(F.col("_all"), lambda a, b: yes((b["pf"] - a["pf"] >= -1e-9) & (b["r"] - a["r"] >= -1e-9))), lambda x: x)
    # The labels.
    label = (
        F.when(F.col("varied") == 0, "No varied settings").when(F.col("better") == 0, "No joint PF and average-R improvement")
        .when(F.col("better") == 1, "POSSIBLE OVERFIT: isolated single-value improvement")
        .when((F.col("_low") >= 0.5) | (F.col("_kept") < 50), "Improvement largely coincides with collapsing trade count")
        .when((F.col("better") == F.col("varied")) & rising, "Broad monotonic improvement across tested values")
        .when(adjacent, "Stable adjacent-value plateau; not necessarily monotonic").otherwise("Unstable/non-monotonic behavior")
    )
    return found.withColumn("trend", label).drop("_low", "_kept", "_all")
