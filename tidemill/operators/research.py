"""Research aggregates over trades, activity, orders, folds and variants: all are grouped aggregations and joins by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.candles import div
from tidemill.operators.compare import greedy_match
from tidemill.operators.metrics import loss, win
from tidemill.operators.stored import stored


def flag_sum(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def consistency_screen(trades: DataFrame, buckets: dict[str, Column], cells: list[str], value: str = "r") -> DataFrame:
    """For each bucket of each feature: cells with a positive mean, all cells, the fewest trades of a cell, trades and mean."""
    named = F.array(*[F.struct(F.lit(f).alias("feature"), b.cast("string").alias("bucket")) for f, b in buckets.items()])
    rows = trades.select(*cells, F.col(value).alias("_v"), F.inline(named)).filter("bucket is not null")
    by_cell = rows.groupBy("feature", "bucket", *cells).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    found = by_cell.groupBy("feature", "bucket").agg(
        flag_sum(F.col("_s") > 0).alias("positive_cells"), F.count("*").alias("cells"), F.min("_n").alias("fewest"), F.sum("_n").alias("trades"), F.sum("_s").alias("_s")
    )
    return found.withColumn("mean", div(F.col("_s"), F.col("trades"))).drop("_s")


def separation_stability(trades: DataFrame, features: list[str], period: str, pnl: str = "pnl") -> DataFrame:
    """Whether the distance of winners' and losers' medians has one sign, and is never 0, in every period that has both."""
    rows = trades.unpivot([period, pnl], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    medians = rows.groupBy("feature", period).agg(F.percentile(F.when(win(pnl), F.col("value")), 0.5).alias("_w"), F.percentile(F.when(loss(pnl), F.col("value")), 0.5).alias("_l"))
    sign = F.signum(F.col("_w") - F.col("_l"))
    found = medians.withColumn("_sign", sign).groupBy("feature").agg(F.count("*").alias("periods"), F.count("_sign").alias("_known"), F.min("_sign").alias("_lo"), F.max("_sign").alias("_hi"))
    one = (F.col("_known") == F.col("periods")) & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") != 0)
    return found.select("feature", "periods", F.coalesce(one, F.lit(False)).alias("consistent"))


def loss_attribution(trades: DataFrame, dimensions: dict[str, Column], value: str = "r") -> DataFrame:
    """Total, mean and count by each dimension alone; a null key is ``undefined``. Each trade is dealt to its dimensions
    and added up before the shuffle."""
    cells = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("undefined")).alias("key")) for n, c in dimensions.items()])
    rows = trades.select(F.col(value).alias("_v"), F.inline(cells))
    return rows.groupBy("dimension", "key").agg(F.sum("_v").alias("total"), F.avg("_v").alias("mean"), F.count("_v").alias("n"))


def failure_profile(trades: DataFrame, limits: dict[str, tuple[float, float]], period: str, excursion: str = "mfe_r", pnl: str = "pnl") -> DataFrame:
    """How far losers went before they failed: counts and shares in right-closed intervals, by period and for all."""
    losers = trades.filter(loss(pnl))
    counts = [flag_sum((F.col(excursion) > lo) & (F.col(excursion) <= hi)).alias(n) for n, (lo, hi) in limits.items()]
    found = losers.rollup(period).agg(F.count("*").alias("losers"), F.grouping(period).alias("_all"), *counts)
    found = found.filter("losers > 0").withColumn(period, F.when(F.col("_all") == 1, "all").otherwise(F.col(period).cast("string"))).drop("_all")
    return found.withColumns({f"{n}_share": F.round(div(F.col(n) * 1.0, F.col("losers")), 4) for n in limits})


def outcome_cells(events: DataFrame, dimensions: list[str], result: str = "outcome", value: str = "r") -> DataFrame:
    """Wins, losses, open cases, win rate of the decided and mean result for each cell and pooled over each dimension."""
    found = events.cube(*dimensions).agg(
        F.count("*").alias("n"), flag_sum(F.col(result) == "WIN").alias("wins"), flag_sum(F.col(result) == "LOSS").alias("losses"), F.avg(value).alias("expectancy"),
        *[F.grouping(d).alias(f"_{d}") for d in dimensions],
    )
    found = found.withColumns({d: F.when(F.col(f"_{d}") == 1, "All").otherwise(F.col(d).cast("string")) for d in dimensions}).drop(*[f"_{d}" for d in dimensions])
    return found.withColumn("win_rate", div(F.col("wins") * 1.0, F.col("wins") + F.col("losses")))


def lifecycle_counts(log: DataFrame, since: Column | None = None) -> DataFrame:
    """Orders and exits of a bar log (``status``, ``exit_ts``, ``exit_reason``, ``ts``), from a time on if given."""
    rows = log if since is None else log.filter(F.col("ts") >= since)
    statuses = [flag_sum(F.col("status") == s).alias(s.lower()) for s in ("CREATED", "FILLED", "EXPIRED", "CANCELLED")]
    reason = F.col("exit_reason")
    return rows.agg(
        F.count("*").alias("bars"), *statuses, F.count("exit_ts").alias("exits"), flag_sum(reason.startswith("Stop loss")).alias("stop_exits"), flag_sum(reason.startswith("Take profit")).alias("target_exits")
    )


def open_state(log: DataFrame, keys: list[str]) -> DataFrame:
    """State at the last row of each log: its status where an order still waits, and the latest entry if entries outnumber
    exits. One aggregation, no ordering."""
    entry = F.when(F.col("entry_ts").isNotNull(), F.col("ts"))
    found = log.groupBy(*keys).agg(
        F.max("ts").alias("last_ts"), F.max_by("status", "ts").alias("_status"), F.count("entry_ts").alias("_in"), F.count("exit_ts").alias("_out"), F.max_by("entry_ts", entry).alias("_entry")
    )
    return found.select(*keys, "last_ts", F.when(F.col("_status").isin("CREATED", "ACTIVE"), F.col("_status")).alias("pending"), F.when(F.col("_in") > F.col("_out"), F.col("_entry")).alias("open_since"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Shares and medians over walk-forward folds (``status``, ``pnl``, ``average_r``, ``profit_factor``, ``drawdown``); only
    selected folds count but for the coverage. Folds are few."""
    chosen = F.col("status") == "SELECTED"

    def of(c: str) -> Column:
        return F.when(chosen, F.col(c))

    n = flag_sum(chosen)
    return folds.agg(
        div(flag_sum(chosen & (F.col("pnl") > 0)) * 100.0, n).alias("profitable_percent"), div(flag_sum(chosen & (F.col("average_r") > 0)) * 100.0, n).alias("positive_r_percent"),
        F.percentile(of("profit_factor"), 0.5).alias("median_profit_factor"), F.percentile(of("average_r"), 0.5).alias("median_r"), F.percentile(of("drawdown"), 0.5).alias("median_drawdown"),
        F.min(of("average_r")).alias("worst_r"), F.max(of("drawdown")).alias("worst_drawdown"), div(n * 100.0, F.count("*")).alias("coverage_percent"),
    )


def activity_by_period(activity: DataFrame, period: Column, name: str) -> DataFrame:
    """Signals, orders, fills and the fill rate of each period, from rows of ``kind`` and ``status``."""
    order = F.col("kind") == "order"
    found = activity.groupBy(period.alias(name)).agg(flag_sum(F.col("kind") == "signal").alias("signals"), flag_sum(order).alias("orders"), flag_sum(order & (F.col("status") == "triggered")).alias("fills"))
    return found.withColumn("fill_rate", F.when(F.col("orders") > 0, F.col("fills") * 100.0 / F.col("orders")).otherwise(0.0))


def participation(trades: DataFrame, gates: dict[str, Column], keys: list[str]) -> DataFrame:
    """Trades that each gate allows and blocks, by key; a null gate blocks."""
    cells = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("allowed")) for n, c in gates.items()])
    return trades.select(*keys, F.inline(cells)).groupBy("gate", *keys).agg(flag_sum(F.col("allowed")).alias("allowed"), flag_sum(~F.col("allowed")).alias("blocked"))


def neighbour_stability(variants: DataFrame, keys: list[str], place: str, control: dict[str, float], step: float) -> DataFrame:
    """Whether a variant beats the control in every measure, and whether a neighbour one step away does: an improvement
    without one may be overfit. Variants meet their neighbours by equality."""
    better = F.lit(True)
    for measure, base in control.items():
        better &= F.coalesce(F.col(measure) > base, F.lit(False))
    rows = variants.withColumn("improves", better)
    near = rows.select(*keys, F.explode(F.array(F.col(place) - step, F.col(place) + step)).alias(place), F.col("improves").alias("_n"))
    near = near.groupBy(*keys, place).agg(F.max("_n").alias("_n"))
    found = rows.join(near, [*keys, place], "left").withColumn("neighbour_improves", F.coalesce("_n", F.lit(False))).drop("_n")
    return found.withColumn("possible_overfit", F.col("improves") & ~F.col("neighbour_improves"))


def fill_quality(trades: DataFrame, bar: Column, gap: Column, pnl: str = "pnl") -> DataFrame:
    """Trades and net by the bar of the fill and by how the trigger was crossed, for each direction and for all."""
    sides = F.explode(F.array(F.lit("All"), F.initcap(F.lower("direction"))))
    rows = trades.select(F.col(pnl).alias("_v"), sides.alias("side"), bar.alias("_bar"), gap.alias("_gap"))
    named = (("Pending fill bar", "_bar"), ("Trigger crossing", "_gap"))
    cells = F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(c).alias("fill")) for n, c in named])
    rows = rows.select("_v", "side", F.inline(cells)).filter("fill is not null")
    return rows.groupBy("comparison", "fill", "side").agg(F.count("_v").alias("trades"), F.sum("_v").alias("net"))


def stopped_summary(trades: DataFrame, levels: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), excursion: str = "mfe_r") -> DataFrame:
    """Trades that left at the stop: count, mean excursion, and the share that reached each level before (0 without any)."""
    stopped = trades.filter(F.col("exit_reason").startswith("Stop loss"))
    reached = [F.coalesce(F.avg(F.when(F.col(excursion) >= x, 100.0).otherwise(0.0)), F.lit(0.0)).alias(f"reached_{x:g}r_percent".replace(".", "_")) for x in levels]
    return stopped.agg(F.count("*").alias("trades"), F.coalesce(F.avg(excursion), F.lit(0.0)).alias("average_mfe_r"), *reached)


def surface(variants: DataFrame, x: str, metric: str, y: str | None = None) -> DataFrame:
    """A metric over one or two parameters: count, mean and best of the variants at each place."""
    return variants.groupBy(*([x] if y is None else [x, y])).agg(F.count(metric).alias("variants"), F.avg(metric).alias("mean"), F.max(metric).alias("best"))


def overlap_check(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Rows that two tables share by key, and how many agree in every value (two nulls agree)."""
    joined = left.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values]).join(right.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values]), keys)
    same = F.lit(True)
    for v in values:
        a, b = F.col(f"{v}_a"), F.col(f"{v}_b")
        same &= a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return joined.agg(F.count("*").alias("overlap"), flag_sum(same).alias("agree"), flag_sum(~same).alias("differ"))


def bucket_minimum(rows: DataFrame, keys: list[str], value: str, width: int, ts: str = "ts") -> DataFrame:
    """Smallest value of each key and bucket of time."""
    from tidemill.operators.bars import bucket

    return rows.groupBy(*keys, bucket(ts, width).alias(ts)).agg(F.min(value).alias(value))


def row_search(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, whatever the case; nulls match nothing."""
    found = F.lit(False)
    for c in rows.columns:
        found |= F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(text.lower())), F.lit(False))
    return rows.filter(found)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails in the task that meets a key twice on either side."""

    def checked(side: DataFrame) -> DataFrame:
        rest = [c for c in side.columns if c not in keys]
        once = side.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
        sure = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("a key occurs twice")))
        return once.select(*keys, sure.alias("_row")).select(*keys, "_row.*")

    return checked(left).join(checked(right), keys)


def equity_before(trades: DataFrame, keys: list[str], period: Column, name: str, initial: float, pnl: str = "pnl") -> DataFrame:
    """Balance of each series before each of its periods; the ordered window sees one row for each period."""
    parts = trades.groupBy(*keys, period.alias(name)).agg(F.sum(pnl).alias("_net"))
    before = F.sum("_net").over(Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("opening", F.lit(float(initial)) + F.coalesce(before, F.lit(0.0))).drop("_net")


def signal_match(left: DataFrame, right: DataFrame, step: int = 900) -> DataFrame:
    """Pairs signals (``ts``, ``direction``, ``id``) of two feeds one to one: first those of equal time and direction, then
    the nearest of equal direction within a step, then the nearest of opposite direction; the rest is unmatched.

    Each pass is a join by equality or a matching within short blocks of time, over what the pass before left. The signals
    and each pass's pairs are stored, so that no pass runs again for those after it."""
    left, right = stored(left), stored(right)
    turn = Window.partitionBy("ts", "direction").orderBy("id")  # copies at one time
    a, b = (x.withColumn("_turn", F.row_number().over(turn)) for x in (left, right))
    exact = a.select("ts", "direction", "_turn", F.col("id").alias("left_id")).join(b.select("ts", "direction", "_turn", F.col("id").alias("right_id")), ["ts", "direction", "_turn"])
    found = stored(exact.select("left_id", "right_id", F.lit("EXACT").alias("match")))
    other = F.when(F.col("direction") == "LONG", "SHORT").otherwise("LONG")
    for label, side in (("NEAR", F.col("direction")), ("OPPOSITE", other)):
        rest_l = left.join(found.select(F.col("left_id").alias("id")), "id", "left_anti")
        rest_r = right.join(found.select(F.col("right_id").alias("id")), "id", "left_anti").withColumn("direction", side)
        pairs = greedy_match(stored(rest_l), stored(rest_r), ["direction"], step)
        found = stored(found.union(pairs.select("left_id", "right_id", F.lit(label).alias("match"))))
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("left_id").alias("id"), F.col("right_id").alias("other"), F.col("match").alias("match")),
        F.struct(F.lit(1).alias("side"), F.col("right_id").alias("id"), F.col("left_id").alias("other"), F.col("match").alias("match")),
    )
    both = left.select(F.lit(0).alias("side"), "id").union(right.select(F.lit(1).alias("side"), "id"))
    rows = both.join(found.select(F.inline(ends)), ["side", "id"], "left").filter("side = 0 or match is null")
    mine = F.col("side") == 0
    alone = F.when(mine, "LEFT_ONLY").otherwise("RIGHT_ONLY")
    return rows.select(F.when(mine, F.col("id")).alias("left_id"), F.when(mine, F.col("other")).otherwise(F.col("id")).alias("right_id"), F.coalesce("match", alone).alias("match"))


def trade_match(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Outcome of the trades (``id``, ``pnl``, ``entry``) of exactly matched signals; a missing trade is not completed."""
    exact = pairs.filter("match = 'EXACT'").select("left_id", "right_id")
    a = left.select(F.col("id").alias("left_id"), F.col("pnl").alias("pnl_left"), F.col("entry").alias("entry_left"))
    b = right.select(F.col("id").alias("right_id"), F.col("pnl").alias("pnl_right"), F.col("entry").alias("entry_right"))
    x, y = F.col("pnl_left"), F.col("pnl_right")
    outcome = (
        F.when(x.isNull() | y.isNull(), "not both completed").when((x > 0) & (y > 0), "both win").when((x < 0) & (y < 0), "both loss")
        .when(x > 0, "left win / right loss").when(y > 0, "left loss / right win").otherwise("other")
    )
    return exact.join(a, "left_id", "left").join(b, "right_id", "left").withColumns({"outcome": outcome, "entry_gap": F.col("entry_left") - F.col("entry_right")})
