"""Orders of two runs side by side: what became of each in both, why one filled alone, and what differed before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.broker import order_class
from tidemill.operators.carry import chunked, running

#: Classes after which later orders of a segment may differ too.
DIVERGENT = ("SYNTHETIC_ONLY_FILL", "ORIGINAL_ONLY_FILL", "TIMING_CHANGED_FILL", "PRICE_CHANGED_FILL", "OTHER_ORDER_STATE")
FIELDS = ("status", "fill_ts", "fill_price", "cancel_reason", "created_ts", "trigger", "stop")


def _once(orders: DataFrame, key: list[str], side: str) -> DataFrame:
    """Orders by key, of which each occurs once (else the task that meets it again fails); a null setup is a key like any."""
    rows = orders.select(F.struct(*key).alias("_key"), F.struct(*FIELDS).alias(side))
    once = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.first(side).alias(side))
    return once.select("_key", F.when(F.col("_n") == 1, F.col(side)).otherwise(F.raise_error(F.lit("an order's key occurs twice"))).alias(side))


def explained(synthetic_only: Column, spread: float) -> tuple[Column, Column]:
    """Why an order filled in one run alone, by the bid bar of its fill, and the same in words."""
    long, trigger, high = F.col("direction") == "LONG", F.col("trigger"), F.col("bid_high")
    known = F.col("original_status").isNotNull() & F.col("synthetic_status").isNotNull()
    reason = (
        F.when(synthetic_only & long & (high < trigger) & (trigger <= high + spread), "LONG_ASK_TRIGGER")
        .when(synthetic_only & long & (F.col("bid_open") + spread >= trigger), "GAP_EFFECT").when(~long & known, "SHORT_BID_TRIGGER").otherwise("OTHER")
    )
    status = lambda c: F.coalesce(c, F.lit("ORDER_NOT_CREATED"))
    both = F.concat(F.lit("original="), status("original_status"), F.lit(", synthetic="), status("synthetic_status"))
    prices = F.format_string("bid %.2f/%.2f/%.2f/%.2f, spread %.2f, trigger %.2f", "bid_open", "bid_high", "bid_low", "bid_close", F.lit(float(spread)), "trigger")
    return reason, F.concat_ws("; ", reason, both, prices)


def reconciled(original: DataFrame, synthetic: DataFrame, bars: DataFrame, keys: list[str], spread: float, tolerance: float = 1e-9) -> DataFrame:
    """A row for each order of either run, matched by series or segment (``keys``), signal_ts, direction and setup (null
    matches null), with its class. Orders have status, fill_ts, fill_price, cancel_reason, created_ts, trigger and stop.
    Where one run alone filled it, the bid bar of the fill, a reason and its words are added; ``prior_ts`` and
    ``prior_class`` are the last order of the segment before it whose runs diverged. Both sides' keys must be unique. That
    carry runs by days, with a row for each day of each segment."""
    key = [*keys, "signal_ts", "direction", "setup"]
    both = _once(original, key, "_o").join(_once(synthetic, key, "_s"), "_key", "full")
    o, s = F.col("_o"), F.col("_s")
    label = order_class(o["status"], s["status"], o["fill_ts"], s["fill_ts"], o["fill_price"], s["fill_price"], tolerance)
    sides = {f"{name}_{f}": c[f] for f in ("status", "fill_ts", "fill_price", "cancel_reason") for name, c in (("original", o), ("synthetic", s))}
    common = {f: F.when(s.isNotNull(), s[f]).otherwise(o[f]) for f in ("created_ts", "trigger", "stop")}
    rows = both.withColumns({"class": label, **sides, **common}).select("_key.*", *sides, *common, "class")
    alone = F.col("class").isin("SYNTHETIC_ONLY_FILL", "ORIGINAL_ONLY_FILL")
    only = F.col("class") == "SYNTHETIC_ONLY_FILL"
    rows = rows.withColumn("audit_ts", F.when(alone, F.when(only, F.col("synthetic_fill_ts")).otherwise(F.col("original_fill_ts"))))
    seen = bars.select(*keys, F.col("ts").alias("audit_ts"), *[F.col(c).cast("double").alias(f"bid_{c}") for c in ("open", "high", "low", "close")])
    rows = rows.join(seen, [*keys, "audit_ts"], "left")
    reason, words = explained(only, spread)
    state = F.concat(F.lit("STATE_DIVERGENCE; original="), F.coalesce("original_status", F.lit("not created")), F.lit(", synthetic="), F.coalesce("synthetic_status", F.lit("not created")))
    other = F.col("class") == "OTHER_ORDER_STATE"
    rows = rows.withColumns({"reason": F.when(alone, reason).when(other, "STATE_DIVERGENCE"), "explanation": F.when(alone, words).when(other, state)})
    order = ["signal_ts", "direction", "setup"]
    differs = F.when(F.col("class").isin(*DIVERGENT), F.struct(*order, "class"))
    carried = running(chunked(rows, keys, order), keys, order, maxima={"_prior": differs}, before=True).drop("_chunk")
    before = F.concat(F.lit("; before it "), F.date_format("_prior.signal_ts", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col("_prior.class"))
    text = F.when(F.col("explanation").isNotNull() & F.col("_prior").isNotNull(), F.concat("explanation", before)).otherwise(F.col("explanation"))
    return carried.withColumns({"prior_ts": F.col("_prior.signal_ts"), "prior_class": F.col("_prior.class"), "explanation": text}).drop("_prior")
