"""Queries over whole tables, each with its DuckDB equivalent where SQL can express it.

Series come from ``events`` (one for each event type; the price is the value plus 100), daily bars from ``lineitem``, trades
from ``orders`` (one series for each priority; the result is the total price less 150,000).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import candles as cx
from tidemill.operators import bars as B
from tidemill.operators import execution as X
from tidemill.operators import indicators as I
from tidemill.operators import joins as J
from tidemill.operators import metrics as M
from tidemill.operators import rolling as R
from tidemill.operators import search as V
from tidemill.operators import segments as S
from tidemill.operators import signals as G
from tidemill.sources import ohlcv as O

KEY = ["symbol"]
SEG = ["symbol", "segment_id"]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", (F.col("value") + 100).alias("price"), F.col("value").alias("raw"))


def bars(spark, d, width: int = 900) -> DataFrame:
    return B.ohlc(ticks(spark, d), KEY, F.col("price"), ["ts", "event_id"], width)


def series(spark, d, width: int = 3600) -> DataFrame:
    """Bars with segments."""
    return S.with_segments(bars(spark, d, width), KEY, width)


def trades(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("trade_id"),
        F.col("o_orderstatus").alias("direction"), (F.col("o_totalprice") - 150000).alias("pnl"), ((F.col("o_totalprice") - 150000) / 50000).alias("r"), F.col("o_totalprice").alias("price"),
    )


def month_range(rows: DataFrame, ts: str = "ts"):
    """First day of a table's first month, and of the month after its last."""
    found = rows.agg(F.date_trunc("month", F.min(ts)).cast("date").alias("a"), F.add_months(F.date_trunc("month", F.max(ts)).cast("date"), 1).alias("b")).first()
    return found["a"], found["b"]


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def bars_sql(width: str = "15 minutes") -> str:
    return f"""ticks AS (SELECT event_type AS symbol, ts, event_id, user_id, value + 100 AS price, value AS raw FROM events),
bars AS (SELECT symbol, time_bucket(interval '{width}', ts) AS bts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
 last(price ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, count(*) AS ticks FROM ticks GROUP BY 1, 2),
b AS (SELECT symbol, bts AS ts, open, high, low, close, volume, ticks FROM bars)"""


def seg_sql(width: str = "1 hour", secs: int = 3600) -> str:
    return bars_sql(width) + f""",
st AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) = {secs} THEN 0 ELSE 1 END AS brk FROM b),
s AS (SELECT symbol, ts, open, high, low, close, volume, ticks, CAST(sum(brk) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM st),
seg AS (SELECT symbol, segment_id, min(ts) AS segment_start, max(ts) AS segment_end, count(*) AS candles FROM s GROUP BY 1, 2)"""


TRADES = "t AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS trade_id, o_orderstatus AS direction, o_totalprice - 150000 AS pnl, (o_totalprice - 150000) / 50000 AS r, o_totalprice AS price FROM orders)"
W1 = "OVER (PARTITION BY symbol, segment_id ORDER BY ts"


# --- resampling


@query(f"WITH {bars_sql()} SELECT * FROM b")
def ohlc_resample_15m(spark, d):
    return bars(spark, d)


@query("""SELECT l_returnflag AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 round(sum(l_quantity), 6) AS volume, count(*) AS ticks FROM lineitem GROUP BY 1, 2""")
def daily_bars(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"))
    return rows.agg(F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.round(F.sum("l_quantity"), 6).alias("volume"), F.count("*").alias("ticks"))


@query(f"""WITH {bars_sql()} SELECT symbol, time_bucket(interval '1 hour', ts) AS h, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
 sum(volume) AS volume, count(*) AS parts FROM b GROUP BY 1, 2 HAVING count(*) = 4""".replace(" AS h,", " AS ts,").replace("GROUP BY 1, 2 HAVING", "GROUP BY symbol, time_bucket(interval '1 hour', ts) HAVING"))
def complete_hours(spark, d):
    return B.complete(bars(spark, d), KEY, 3600, 900)


@query("""WITH q AS (SELECT event_type AS symbol, ts, event_id, value + 100 AS bid, value + 100 + (user_id % 7 + 1) * 0.01 AS ask FROM events)
SELECT symbol, time_bucket(interval '1 hour', ts) AS ts, count(*) AS ticks, round(first(ask - bid ORDER BY ts, event_id), 6) AS spread_open, round(quantile_cont(ask - bid, 0.5), 6) AS spread_median,
 round(avg(ask - bid), 6) AS spread_mean, round(max(ask - bid), 6) AS spread_max, first(bid ORDER BY ts, event_id) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, last(bid ORDER BY ts, event_id) AS bid_close,
 round(first(ask ORDER BY ts, event_id), 6) AS ask_open, round(max(ask), 6) AS ask_high, round(min(ask), 6) AS ask_low, round(last(ask ORDER BY ts, event_id), 6) AS ask_close FROM q GROUP BY symbol, time_bucket(interval '1 hour', ts)""")
def quote_bars(spark, d):
    quotes = ticks(spark, d).withColumnRenamed("price", "bid").withColumn("ask", F.col("bid") + (F.col("user_id") % 7 + 1) * 0.01)
    found = B.quote_bars(O.normalised_quotes(quotes).drop("spread"), KEY, ["ts", "event_id"], 3600)
    return found.withColumns(r6("spread_open", "spread_median", "spread_mean", "spread_max", "ask_open", "ask_high", "ask_low", "ask_close"))


@query(f"""WITH {bars_sql('1 hour')}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 7 AS g FROM b)
SELECT symbol, min(ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM n GROUP BY symbol, g""")
def chart_downsample(spark, d):
    return B.downsample_by_count(bars(spark, d, 3600), KEY, 7)


@query("""SELECT event_type AS symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def weekly_summary(spark, d):
    return ticks(spark, d).groupBy("symbol", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"), F.round(F.avg("raw"), 6).alias("mean"))


# --- quality and segments


@query(f"""WITH {bars_sql()} SELECT symbol, count(*) AS n_rows, count(DISTINCT ts) AS n_ts, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CASE WHEN low <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid,
 CAST(sum(CASE WHEN CAST(epoch(ts) AS BIGINT) % 900 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS off_grid, count(*) - count(DISTINCT ts) AS duplicates,
 CAST((epoch(max(ts)) - epoch(min(ts))) / 900 + 1 AS BIGINT) AS expected, CAST((epoch(max(ts)) - epoch(min(ts))) / 900 + 1 AS BIGINT) - count(DISTINCT ts) AS missing FROM b GROUP BY symbol""")
def quality_report(spark, d):
    return S.quality_report(bars(spark, d), KEY)


@query("""SELECT event_id, event_type AS symbol, value FROM events WHERE value <= 0 OR value IS NULL""")
def invalid_candles(spark, d):
    rows = ticks(spark, d).select("event_id", "symbol", *[F.col("raw").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    return rows.filter(cx.invalid_ohlcv()).select("event_id", "symbol", F.col("open").alias("value"))


@query(f"WITH {seg_sql('15 minutes', 900)} SELECT * FROM seg")
def segments(spark, d):
    return S.segments(bars(spark, d), KEY)


@query(f"""WITH {seg_sql('15 minutes', 900)}, n AS (SELECT *, lead(segment_start) OVER (PARTITION BY symbol ORDER BY segment_start) AS nx FROM seg)
SELECT symbol, segment_end + interval '15 minutes' AS gap_start, nx - interval '15 minutes' AS gap_end, CAST((epoch(nx) - epoch(segment_end)) / 900 - 1 AS BIGINT) AS missing FROM n WHERE nx IS NOT NULL""")
def missing_gaps(spark, d):
    return S.missing_gaps(S.segments(bars(spark, d), KEY), KEY)


@query(f"""WITH {seg_sql('15 minutes', 900)}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY candles DESC, segment_start) AS k FROM seg) SELECT symbol, segment_id, segment_start, segment_end, candles FROM n WHERE k = 1""")
def largest_segment(spark, d):
    return S.largest_segment(S.segments(bars(spark, d), KEY), KEY)


@query(f"""WITH {bars_sql('1 hour')}, e AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM b GROUP BY symbol),
c AS (SELECT symbol, unnest(generate_series(lo, hi, interval '1 hour')) AS ts FROM e) SELECT c.symbol, c.ts FROM c LEFT JOIN b ON c.symbol = b.symbol AND c.ts = b.ts WHERE b.ts IS NULL""")
def missing_calendar(spark, d):
    return S.missing_calendar(bars(spark, d, 3600), KEY, 3600)


@query(f"""WITH {seg_sql('15 minutes', 900)}, n AS (SELECT *, lead(segment_start) OVER (PARTITION BY symbol ORDER BY segment_start) AS nx FROM seg),
g AS (SELECT symbol, CAST((epoch(nx) - epoch(segment_end)) / 900 - 1 AS BIGINT) AS missing FROM n WHERE nx IS NOT NULL)
SELECT symbol, CASE WHEN missing = 1 THEN '1' WHEN missing <= 4 THEN '2-4' WHEN missing <= 16 THEN '5-16' ELSE '17+' END AS bucket, count(*) AS gaps, CAST(sum(missing) AS BIGINT) AS candles, quantile_cont(missing, 0.5) AS median FROM g GROUP BY 1, 2""")
def gap_buckets(spark, d):
    gaps = S.missing_gaps(S.segments(bars(spark, d), KEY), KEY)
    return gaps.groupBy("symbol", S.gap_bucket(F.col("missing")).alias("bucket")).agg(F.count("*").alias("gaps"), F.sum("missing").alias("candles"), F.percentile("missing", 0.5).alias("median"))


@query(f"""WITH {bars_sql()} SELECT symbol, strftime(ts, '%Y-%m') AS month, count(DISTINCT ts) AS observed, CAST(day(last_day(min(ts))) * 96 AS BIGINT) AS expected, count(DISTINCT ts) / (day(last_day(min(ts))) * 96) AS coverage FROM b GROUP BY 1, 2""")
def month_coverage(spark, d):
    return S.month_coverage(bars(spark, d), KEY)


@query("""WITH u AS (SELECT event_type AS symbol, ts, event_id, value, 0 AS o FROM events UNION ALL SELECT event_type, ts, event_id, value + 1, 1 FROM events WHERE value > 50)
SELECT symbol, ts, event_id, value, o AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY o DESC) AS k FROM u) WHERE k = 1""")
def dedupe_keep_last(spark, d):
    rows = ticks(spark, d).select("symbol", "ts", "event_id", F.col("raw").alias("value"), F.lit(0).alias("ordinal"))
    again = rows.filter("value > 50").withColumns({"value": F.col("value") + 1, "ordinal": F.lit(1)})
    found = S.dedupe_keep_last(rows.union(again), KEY, "ordinal", tie=-F.col("event_id"))  # of equal ordinals the first in the table, as one thread of the SQL takes it
    return found.select("symbol", "ts", "event_id", "value", "ordinal")


# --- joins


@query(f"""WITH {bars_sql()}, st AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) = 900 THEN 0 ELSE 1 END AS brk FROM b),
s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM st),
h AS (SELECT symbol, segment_id, time_bucket(interval '1 hour', ts) AS h1, last(close ORDER BY ts) AS c FROM s GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT s.symbol, s.segment_id, s.ts, s.close, max(h.h1) AS h1_ts, max_by(h.c, h.h1) AS h1_close FROM s LEFT JOIN h ON s.symbol = h.symbol AND s.segment_id = h.segment_id AND h.h1 + interval '1 hour' <= time_bucket(interval '1 hour', s.ts)
GROUP BY 1, 2, 3, 4""")
def h1_context_asof(spark, d):
    return B.hour_context(bars(spark, d), KEY).select("symbol", "segment_id", "ts", "close", "h1_ts", "h1_close")


@query(f"""WITH {bars_sql('1 hour')} SELECT t.symbol, t.ts, t.event_id, b.ts AS asof_ts, b.close AS asof_close FROM ticks t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.ts >= b.ts""")
def ticks_to_parent_bar(spark, d):
    return J.asof_backward(ticks(spark, d).select("symbol", "ts", "event_id"), bars(spark, d, 3600), KEY, "close")


def feeds(spark, d):
    rows = bars(spark, d)
    pick = lambda name: rows.filter(F.col("symbol") == name).select("ts", "close")
    return pick("click"), pick("view")


FEEDS = bars_sql() + ", l AS (SELECT ts, close FROM b WHERE symbol = 'click'), r AS (SELECT ts, close FROM b WHERE symbol = 'view')"


@query(f"WITH {FEEDS} SELECT l.ts, l.close AS close_left, r.close AS close_right, round(l.close - r.close, 6) AS gap FROM l JOIN r ON l.ts = r.ts")
def feed_align_inner(spark, d):
    a, b = feeds(spark, d)
    joined = a.withColumnRenamed("close", "close_left").join(b.withColumnRenamed("close", "close_right"), "ts")
    return joined.withColumn("gap", F.round(F.col("close_left") - F.col("close_right"), 6))


@query(f"""WITH {FEEDS} SELECT coalesce(l.ts, r.ts) AS ts, l.close AS close_left, r.close AS close_right, CASE WHEN r.ts IS NULL THEN 'left_only' WHEN l.ts IS NULL THEN 'right_only' ELSE 'both' END AS place,
 CASE WHEN l.ts IS NOT NULL AND r.ts IS NOT NULL AND NOT abs(l.close - r.close) <= 10 THEN 'close' END AS first_difference FROM l FULL JOIN r ON l.ts = r.ts""")
def feed_full_outer(spark, d):
    a, b = feeds(spark, d)
    return J.reconcile(a, b, ["ts"], ["close"], 10.0)


@query(f"WITH {FEEDS} SELECT 'semi' AS kind, count(*) AS n FROM l WHERE ts IN (SELECT ts FROM r) UNION ALL SELECT 'anti', count(*) FROM l WHERE ts NOT IN (SELECT ts FROM r)")
def feed_semi_anti(spark, d):
    a, b = feeds(spark, d)
    count = lambda how: a.join(b.select("ts"), "ts", f"left_{how}").agg(F.lit(how).alias("kind"), F.count("*").alias("n"))
    return count("semi").union(count("anti"))


@query(f"""WITH {FEEDS} SELECT change, count(*) AS n FROM (SELECT CASE WHEN l.ts IS NULL THEN 'added' WHEN r.ts IS NULL THEN 'displaced' ELSE 'common' END AS change FROM l FULL JOIN r ON l.ts = r.ts) GROUP BY 1""")
def key_delta(spark, d):
    a, b = feeds(spark, d)
    return J.key_delta(a, b, ["ts"])


def positions(spark, d) -> DataFrame:
    """A trade for every event: open for three hours."""
    rows = ticks(spark, d)
    side = F.when(F.col("user_id") % 2 == 0, "LONG").otherwise("SHORT")
    return rows.select("symbol", F.col("event_id").alias("trade_id"), side.alias("direction"), F.col("ts").alias("entry_ts"), (F.col("ts") + F.expr("interval 3 hours")).alias("exit_ts"), F.col("price").alias("entry"))


POSITIONS = "p AS (SELECT event_type AS symbol, event_id AS trade_id, CASE WHEN user_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, ts AS entry_ts, ts + interval '3 hours' AS exit_ts, value + 100 AS entry FROM events)"


@query(f"""WITH {bars_sql()}, {POSITIONS}, x AS (SELECT p.*, b.ts, CASE WHEN direction = 'LONG' THEN high - entry ELSE entry - low END AS best, CASE WHEN direction = 'LONG' THEN entry - low ELSE high - entry END AS worst
 FROM p JOIN b ON p.symbol = b.symbol AND b.ts BETWEEN entry_ts AND exit_ts),
a AS (SELECT trade_id, greatest(max(best), 0) AS mfe, greatest(max(worst), 0) AS mae, first(ts ORDER BY best DESC, ts) AS mfe_ts, first(ts ORDER BY worst DESC, ts) AS mae_ts, count(*) AS bars_held FROM x GROUP BY 1)
SELECT p.*, round(mfe, 6) AS mfe, round(mae, 6) AS mae, mfe_ts, mae_ts, bars_held FROM p LEFT JOIN a ON p.trade_id = a.trade_id""")
def interval_containment_mfe(spark, d):
    return J.excursions(positions(spark, d), bars(spark, d), KEY).withColumns(r6("mfe", "mae"))


@query(f"""WITH {POSITIONS} SELECT a.* FROM p a WHERE direction = 'LONG' AND EXISTS (SELECT 1 FROM p b WHERE b.direction = 'SHORT' AND a.symbol = b.symbol AND a.entry_ts <= b.exit_ts AND a.exit_ts >= b.entry_ts)""")
def interval_overlap(spark, d):
    rows = positions(spark, d)
    return J.overlapping(rows.filter("direction = 'LONG'"), rows.filter("direction = 'SHORT'"), KEY)


@query(f"""WITH {seg_sql()}, n AS (SELECT *, row_number() {W1}) AS k FROM s),
p AS (SELECT a.symbol, a.segment_id, a.ts, min(CASE WHEN z.high >= a.close + 20 THEN z.k END) - a.k AS bars_to_target, min(CASE WHEN z.low <= a.close - 20 THEN z.k END) - a.k AS bars_to_stop
 FROM n a LEFT JOIN n z ON a.symbol = z.symbol AND a.segment_id = z.segment_id AND z.k BETWEEN a.k + 1 AND a.k + 48 GROUP BY a.symbol, a.segment_id, a.ts, a.k)
SELECT *, CASE WHEN bars_to_target IS NULL AND bars_to_stop IS NULL THEN 'OPEN' WHEN bars_to_stop IS NULL OR bars_to_target < bars_to_stop THEN 'TARGET' WHEN bars_to_target IS NULL OR bars_to_stop < bars_to_target THEN 'STOP' ELSE 'AMBIGUOUS' END AS resolution FROM p""")
def first_passage(spark, d):
    found = J.first_passage(series(spark, d), SEG, 20.0, 20.0, 48)
    return found.select(*SEG, "ts", F.col("bars_to_target").cast("long"), F.col("bars_to_stop").cast("long"), "resolution")


# --- windows


@query(f"""WITH {seg_sql()} SELECT symbol, segment_id, ts, CASE WHEN count(*) {W1} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN max(high) {W1} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS prev_high_5,
 CASE WHEN count(*) {W1} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN min(low) {W1} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS prev_low_5,
 min(low) {W1} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS low_2, max(high) {W1} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS high_2 FROM s""")
def rolling_extremes(spark, d):
    return R.structural_stop(R.previous_extremes(series(spark, d), SEG, 5), SEG, 2).select(*SEG, "ts", "prev_high_5", "prev_low_5", "low_2", "high_2")


TR = f"tr AS (SELECT *, CASE WHEN lag(close) {W1}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {W1})), abs(low - lag(close) {W1}))) END AS tr FROM s)"


@query(f"""WITH {seg_sql()}, {TR} SELECT symbol, segment_id, ts, round(tr, 6) AS tr, CASE WHEN count(*) {W1} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14 THEN round(avg(tr) {W1} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) END AS sma_atr FROM tr""")
def sma_atr(spark, d):
    return R.sma_atr(series(spark, d), SEG).select(*SEG, "ts", *[F.round(c, 6).alias(c) for c in ("tr", "sma_atr")])


@query(f"""WITH {seg_sql()}, m AS (SELECT *, abs(close - lag(close) {W1})) AS dd FROM s) SELECT symbol, segment_id, ts,
 round(abs(close - lag(close, 20) {W1})) / nullif(sum(dd) {W1} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 6) AS efficiency FROM m""")
def directional_efficiency(spark, d):
    return R.directional_efficiency(series(spark, d), SEG).select(*SEG, "ts", F.round("efficiency", 6).alias("efficiency"))


@query(f"""WITH {seg_sql()}, m AS (SELECT *, sign(close - lag(close) {W1})) AS sg FROM s), f AS (SELECT *, CASE WHEN sg * lag(sg) {W1}) < 0 THEN 1.0 ELSE 0.0 END AS f FROM m)
SELECT symbol, segment_id, ts, CASE WHEN count(*) {W1} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) = 19 THEN round(avg(f) {W1} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW), 6) END AS reversals FROM f""")
def reversal_frequency(spark, d):
    return R.reversal_frequency(series(spark, d), SEG).select(*SEG, "ts", F.round("reversals", 6).alias("reversals"))


@query(f"""WITH {seg_sql()}, n AS (SELECT *, row_number() {W1}) AS k FROM s)
SELECT a.symbol, a.segment_id, a.ts, CASE WHEN count(*) >= 20 THEN round(sum(CASE WHEN z.close <= a.close THEN 1 ELSE 0 END) / count(*), 6) END AS close_rank
FROM n a JOIN n z ON a.symbol = z.symbol AND a.segment_id = z.segment_id AND z.k BETWEEN a.k - 95 AND a.k GROUP BY 1, 2, 3""")
def percentile_rank(spark, d):
    return R.percentile_rank(series(spark, d), SEG, "close").select(*SEG, "ts", F.round("close_rank", 6).alias("close_rank"))


@query(f"""WITH {seg_sql()}, m AS (SELECT *, ln(close / lag(close) {W1})) AS r FROM s) SELECT symbol, segment_id, ts,
 CASE WHEN count(r) {W1} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24 THEN round(stddev_samp(r) {W1} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) * sqrt(24), 6) END AS realised_vol FROM m""")
def realised_volatility(spark, d):
    return R.realised_volatility(series(spark, d), SEG, 24).select(*SEG, "ts", F.round("realised_vol", 6).alias("realised_vol"))


@query(f"""WITH {seg_sql()}, m AS (SELECT *, row_number() {W1}) AS n, lag(high, 2) {W1}) AS mid, lag(high, 3) {W1}) AS l1, lag(high, 4) {W1}) AS l2, lag(high, 1) {W1}) AS r1 FROM s),
h AS (SELECT *, coalesce(mid > l1 AND mid > l2 AND mid >= r1 AND mid >= high, false) AS hit FROM m),
g AS (SELECT *, count(CASE WHEN hit THEN 1 END) {W1} ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT symbol, segment_id, ts, hit AS is_pivot, CASE WHEN g > 0 THEN first_value(mid) OVER (PARTITION BY symbol, segment_id, g ORDER BY ts) END AS pivot_level,
 CASE WHEN g > 0 THEN n - first_value(n) OVER (PARTITION BY symbol, segment_id, g ORDER BY ts) + 2 END AS pivot_age FROM g""")
def pivot_highs(spark, d):
    return R.pivot_highs(series(spark, d), SEG).select(*SEG, "ts", "is_pivot", "pivot_level", F.col("pivot_age").cast("long").alias("pivot_age"))


@query(f"""WITH {seg_sql()}, m AS (SELECT *, row_number() {W1}) AS n FROM s) SELECT symbol, segment_id, ts, n - max(CASE WHEN low < 110 THEN n END) {W1} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM m""")
def bars_since_touch(spark, d):
    return R.bars_since(series(spark, d), SEG, F.col("low") < 110, "since").select(*SEG, "ts", F.col("since").cast("long").alias("since"))


@query(f"""WITH {bars_sql()}, m AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM b)
SELECT symbol, ts, CASE WHEN epoch(ts) - epoch(p) = 900 THEN round(close / pc - 1, 6) END AS ret FROM m""")
def adjacent_returns(spark, d):
    return R.adjacent_return(bars(spark, d), KEY).select("symbol", "ts", F.round("ret", 6).alias("ret"))


@query("""WITH q AS (SELECT event_type AS symbol, ts, event_id, CASE WHEN user_id % 3 <> 0 THEN value END AS bid, CASE WHEN user_id % 3 <> 1 THEN value + 1 END AS ask FROM events)
SELECT symbol, ts, event_id, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM q WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def quote_carry_forward(spark, d):
    rows = ticks(spark, d).select("symbol", F.to_date("ts").alias("day"), "ts", "event_id", F.when(F.col("user_id") % 3 != 0, F.col("raw")).alias("bid"), F.when(F.col("user_id") % 3 != 1, F.col("raw") + 1).alias("ask"))
    return R.carry_forward(rows, ["symbol", "day"], ["ts", "event_id"], ["bid", "ask"]).drop("day")


# --- recurrences (oracles by recursion)

REC = seg_sql("6 hours", 21600) + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol, segment_id ORDER BY ts) AS k FROM s)"


@query(f"""WITH RECURSIVE {REC}, e AS (SELECT symbol, segment_id, k, ts, close AS v FROM n WHERE k = 1 UNION ALL
SELECT n.symbol, n.segment_id, n.k, n.ts, e.v + 0.3333333333333333 * (n.close - e.v) FROM e JOIN n ON n.symbol = e.symbol AND n.segment_id = e.segment_id AND n.k = e.k + 1)
SELECT symbol, segment_id, ts, round(v, 6) AS ema FROM e""")
def ema(spark, d):
    found = I.smoothed(series(spark, d, 21600), SEG, "close", 5, "ema", "ema")
    return found.select(*SEG, "ts", F.round("ema", 6).alias("ema"))


@query(f"""WITH RECURSIVE {REC}, m AS (SELECT *, avg(close) OVER (PARTITION BY symbol, segment_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a FROM n),
e AS (SELECT symbol, segment_id, k, ts, a AS v FROM m WHERE k = 4 UNION ALL SELECT m.symbol, m.segment_id, m.k, m.ts, e.v + (m.close - e.v) / 4 FROM e JOIN m ON m.symbol = e.symbol AND m.segment_id = e.segment_id AND m.k = e.k + 1)
SELECT n.symbol, n.segment_id, n.ts, round(e.v, 6) AS rma FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.segment_id = e.segment_id AND n.k = e.k""")
def rma(spark, d):
    found = I.smoothed(series(spark, d, 21600), SEG, "close", 4, "rma", "rma")
    return found.select(*SEG, "ts", F.round("rma", 6).alias("rma"))


@query(f"""WITH RECURSIVE {REC}, t AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM n WINDOW w AS (PARTITION BY symbol, segment_id ORDER BY ts)),
m AS (SELECT *, avg(tr) OVER (PARTITION BY symbol, segment_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM t),
e AS (SELECT symbol, segment_id, k, a AS v FROM m WHERE k = 5 UNION ALL SELECT m.symbol, m.segment_id, m.k, e.v + (m.tr - e.v) / 5 FROM e JOIN m ON m.symbol = e.symbol AND m.segment_id = e.segment_id AND m.k = e.k + 1)
SELECT n.symbol, n.segment_id, n.ts, round(e.v, 6) AS atr FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.segment_id = e.segment_id AND n.k = e.k""")
def atr_wilder(spark, d):
    found = I.with_indicators(series(spark, d, 21600), SEG, atr=5)
    return found.select(*SEG, "ts", F.round("atr", 6).alias("atr"))


@query(f"""WITH RECURSIVE {REC}, t AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol, segment_id ORDER BY ts) AS mv FROM n),
m AS (SELECT *, avg(greatest(mv, 0)) OVER w AS ag, avg(greatest(-mv, 0)) OVER w AS al FROM t WINDOW w AS (PARTITION BY symbol, segment_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
e AS (SELECT symbol, segment_id, k, ag AS g, al AS l FROM m WHERE k = 6 UNION ALL SELECT m.symbol, m.segment_id, m.k, e.g + (greatest(m.mv, 0) - e.g) / 5, e.l + (greatest(-m.mv, 0) - e.l) / 5 FROM e JOIN m ON m.symbol = e.symbol AND m.segment_id = e.segment_id AND m.k = e.k + 1)
SELECT n.symbol, n.segment_id, n.ts, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE round(100 - 100 / (1 + g / nullif(l, 0)), 6) END AS rsi FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.segment_id = e.segment_id AND n.k = e.k""")
def rsi(spark, d):
    found = I.with_indicators(series(spark, d, 21600), SEG, strength=5)
    return found.select(*SEG, "ts", F.round("rsi", 6).alias("rsi"))


def dense_width(spark, d) -> int:
    """The least usual width of bars at which a bar of a series has six events on average, so that segments are long."""
    n, kinds, first, last = table(spark, d, "events").agg(F.count("*"), F.count_distinct("event_type"), F.min("ts"), F.max("ts")).first()
    between = (last - first).total_seconds() * kinds / n if n else 0
    return next((w for w in (900, 3600, 21_600) if w >= 6 * between), 86_400)


def prepared_bars(spark, d, width: int | None = None) -> DataFrame:
    width = width or dense_width(spark, d)
    rows = R.previous_extremes(R.previous_extremes(series(spark, d, width), SEG, 5), SEG, 8)
    found = I.with_indicators(rows, SEG, fast=5, slow=12, atr=7, strength=7, adx=7)
    return found


@query()
def indicators(spark, d):
    return prepared_bars(spark, d).select(*SEG, "ts", "ema_fast", "ema_slow", "atr", "rsi", "plus_di", "minus_di", "adx")


@query()
def signals_all(spark, d):
    rows, parts = prepared_bars(spark, d), ("direction", "trigger", "stop", "expiry")
    makers = {"cross": lambda x: G.ema_cross(x, SEG, 12), "breakout": lambda x: G.breakout(x, SEG, adx=10.0, body=0.3), "sweep": lambda x: G.sweep(x, body=0.1, most=2.0), "overshoot": lambda x: G.overshoot(x, adx=40.0, near=0.2)}
    for name, make in makers.items():  # one build of the bars: each signal is a column, and then a row
        rows = make(rows).withColumn(f"_{name}", F.struct(F.lit(name).alias("setup"), *parts)).drop(*parts)
    found = rows.select(*SEG, "ts", F.explode(F.array(*[f"_{name}" for name in makers])).alias("_s"))
    return found.select(*SEG, "ts", "_s.*").filter("direction is not null")


# --- candle functions

SHARES = "CASE WHEN high > low THEN {} / (high - low) ELSE 0 END"


@query(f"""WITH {bars_sql()} SELECT symbol, ts, round({SHARES.format('abs(close - open)')}, 6) AS body, CASE WHEN high > low THEN round((close - low) / (high - low), 6) END AS location,
 round({SHARES.format('(high - greatest(open, close))')}, 6) AS upper, round({SHARES.format('(least(open, close) - low)')}, 6) AS lower FROM b""")
def candle_shapes(spark, d):
    return bars(spark, d).select("symbol", "ts", F.round(cx.body_share(), 6).alias("body"), F.round(cx.close_location(), 6).alias("location"), F.round(cx.upper_wick(), 6).alias("upper"), F.round(cx.lower_wick(), 6).alias("lower"))


@query("""SELECT event_id, round(least(10000 * 0.01 / (5 + 0.001 * (2 * (value + 100) - 5)), 10000 * 2 / (value + 100)), 6) AS quantity, round((value + 100) * 1.001, 6) AS slipped, round(100.0 / (1 + value), 6) AS breakeven FROM events""")
def position_sizing(spark, d):
    rows = ticks(spark, d)
    quantity = cx.position_size(F.lit(10000.0), F.col("price"), F.col("price") - 5, 1.0, 2.0, 0.1)
    return rows.select("event_id", F.round(quantity, 6).alias("quantity"), F.round(cx.slipped(F.col("price"), F.lit("LONG"), 0.1), 6).alias("slipped"), F.round(cx.breakeven_win_rate(F.col("raw")) * 100, 6).alias("breakeven"))


@query(f"WITH {bars_sql()} SELECT symbol, count(*) AS n FROM b WHERE hour(ts) * 60 + minute(ts) >= 480 AND hour(ts) * 60 + minute(ts) < 1020 AND isodow(ts) <= 5 GROUP BY symbol")
def session_gate(spark, d):
    return bars(spark, d).filter(G.in_session(480, 1020, [0, 1, 2, 3, 4])).groupBy("symbol").agg(F.count("*").alias("n"))


# --- trade statistics

STATS = """count(pnl) AS trades, count(CASE WHEN pnl > 1e-9 THEN 1 END) AS wins, count(CASE WHEN pnl < -1e-9 THEN 1 END) AS losses, count(pnl) - count(CASE WHEN pnl > 1e-9 THEN 1 END) - count(CASE WHEN pnl < -1e-9 THEN 1 END) AS breakeven,
 round(coalesce(sum(CASE WHEN pnl > 1e-9 THEN pnl END), 0), 2) AS gross_profit, round(coalesce(sum(CASE WHEN pnl < -1e-9 THEN -pnl END), 0), 2) AS gross_loss, round(sum(pnl), 2) AS net, round(avg(CASE WHEN pnl > 1e-9 THEN pnl END), 2) AS avg_win,
 round(avg(CASE WHEN pnl < -1e-9 THEN pnl END), 2) AS avg_loss, round(max(pnl), 2) AS best, round(min(pnl), 2) AS worst, round(count(CASE WHEN pnl > 1e-9 THEN 1 END) * 100.0 / count(pnl), 6) AS win_rate,
 CASE WHEN sum(CASE WHEN pnl < -1e-9 THEN -pnl END) > 0 THEN round(coalesce(sum(CASE WHEN pnl > 1e-9 THEN pnl END), 0) / sum(CASE WHEN pnl < -1e-9 THEN -pnl END), 6) WHEN sum(CASE WHEN pnl > 1e-9 THEN pnl END) > 0 THEN 'inf'::DOUBLE END AS profit_factor, round(sum(pnl) / count(pnl), 2) AS expectancy"""


def _rounded(df: DataFrame) -> DataFrame:
    two = ("gross_profit", "gross_loss", "net", "avg_win", "avg_loss", "best", "worst", "expectancy")
    return df.withColumns({n: F.round(n, 2) for n in two} | r6("win_rate", "profit_factor"))


@query(f"WITH {TRADES} SELECT symbol, {STATS}, round(avg(r), 6) AS avg_r, round(quantile_cont(r, 0.5), 6) AS median_r FROM t GROUP BY symbol")
def trade_metrics(spark, d):
    return _rounded(M.trade_stats(trades(spark, d), KEY, r="r")).withColumns(r6("avg_r", "median_r"))


@query(f"WITH {TRADES} SELECT strftime(ts, '%Y-%m') AS month, {STATS} FROM t GROUP BY 1")
def group_stats_month(spark, d):
    return _rounded(M.trade_stats(trades(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM")), ["month"]))


@query(f"WITH {TRADES} SELECT direction, {STATS} FROM t GROUP BY 1")
def direction_stats(spark, d):
    return _rounded(M.trade_stats(trades(spark, d), ["direction"]))


EQUITY = """w AS (SELECT *, 10000000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS balance FROM t),
q AS (SELECT *, greatest(10000000, max(balance) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM w)"""


@query(f"WITH {TRADES}, {EQUITY} SELECT symbol, trade_id, round(balance, 2) AS balance, round(peak, 2) AS peak, round(peak - balance, 2) AS drawdown, round((peak - balance) * 100 / peak, 6) AS drawdown_percent FROM q")
def equity_curve(spark, d):
    found = M.with_equity(trades(spark, d), KEY, ["ts", "trade_id"], 1e7)
    return found.select("symbol", "trade_id", *[F.round(c, 2).alias(c) for c in ("balance", "peak", "drawdown")], F.round("drawdown_percent", 6).alias("drawdown_percent"))


@query(f"WITH {TRADES}, {EQUITY} SELECT symbol, round(max(peak - balance), 2) AS max_drawdown, round(max((peak - balance) * 100 / peak), 6) AS max_drawdown_percent, round(last(balance ORDER BY ts, trade_id), 2) AS final_balance FROM q GROUP BY 1")
def max_drawdown(spark, d):
    found = M.max_drawdown(trades(spark, d), KEY, ["ts", "trade_id"], 1e7)
    return found.withColumns({"max_drawdown": F.round("max_drawdown", 2), "max_drawdown_percent": F.round("max_drawdown_percent", 6), "final_balance": F.round("final_balance", 2)})


@query(f"""WITH {TRADES}, g AS (SELECT *, sum(CASE WHEN pnl > 1e-9 THEN 0 ELSE 1 END) OVER w AS gw, sum(CASE WHEN pnl < -1e-9 THEN 0 ELSE 1 END) OVER w AS gl FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT symbol, gw, sum(CASE WHEN pnl > 1e-9 THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1, 2), c AS (SELECT symbol, gl, sum(CASE WHEN pnl < -1e-9 THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1, 2)
SELECT x.symbol, x.max_wins, y.max_losses FROM (SELECT symbol, CAST(max(n) AS BIGINT) AS max_wins FROM a GROUP BY 1) x JOIN (SELECT symbol, CAST(max(n) AS BIGINT) AS max_losses FROM c GROUP BY 1) y ON x.symbol = y.symbol""")
def streaks(spark, d):
    return M.streaks(trades(spark, d), KEY, ["ts", "trade_id"])


@query(f"""WITH {TRADES}, w AS (SELECT symbol, CASE WHEN count(*) OVER v = 20 THEN sum(r) OVER v END AS s FROM t WINDOW v AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, round(min(s), 6) AS worst_rolling FROM w GROUP BY 1""")
def worst_rolling(spark, d):
    return M.worst_rolling(trades(spark, d), KEY, ["ts", "trade_id"], 20).withColumns(r6("worst_rolling"))


@query()
def longest_recovery(spark, d):
    return M.longest_recovery(trades(spark, d), KEY, ["ts", "trade_id"])


@query("""WITH q AS (SELECT (user_id % 7 + 1) * 0.01::DOUBLE AS spread, hour(ts) AS hour, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m') AS month FROM events)
SELECT CASE WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(weekday) = 0 THEN 'weekday' WHEN grouping(month) = 0 THEN 'month' ELSE 'overall' END AS dimension, coalesce(CAST(hour AS VARCHAR), CAST(weekday AS VARCHAR), month, 'all') AS key,
 count(spread) AS n, round(avg(spread), 6) AS mean, round(min(spread), 6) AS low, round(max(spread), 6) AS high, round(quantile_cont(spread, 0.5), 6) AS median, round(quantile_cont(spread, 0.95), 6) AS p95 FROM q GROUP BY GROUPING SETS ((), (hour), (weekday), (month))""")
def spread_history(spark, d):
    rows = ticks(spark, d).withColumn("spread", (F.col("user_id") % 7 + 1) * 0.01)
    found = M.grouping_report(rows, "spread", {"hour": F.hour("ts"), "weekday": F.weekday("ts"), "month": F.date_format("ts", "yyyy-MM")})
    return found.withColumns(r6("mean", "low", "high", "median", "p95"))


@query(f"""WITH {TRADES} SELECT CASE WHEN price >= 0 AND price < 50000 THEN '0-50000' WHEN price < 150000 THEN '50000-150000' WHEN price < 300000 THEN '150000-300000' WHEN price <= 1000000 THEN '300000-1e+06' END AS bucket, {STATS} FROM t GROUP BY 1""")
def bucket_fixed(spark, d):
    return _rounded(M.trade_stats(M.bucketed(trades(spark, d), "price", [0, 50000, 150000, 300000, 1000000]), ["bucket"]))


@query(f"""WITH {TRADES}, e AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS e FROM t) SELECT CAST(len(list_filter(e, lambda x: x < price)) + 1 AS INTEGER) AS quantile, {STATS} FROM t, e GROUP BY 1""")
def bucket_quartile(spark, d):
    return _rounded(M.trade_stats(M.quantile_bucketed(trades(spark, d), "price"), ["quantile"]))


@query(f"""WITH {TRADES}, f AS (SELECT 'price' AS feature, CASE WHEN pnl > 1e-9 THEN 'winner' WHEN pnl < -1e-9 THEN 'loser' END AS outcome, price AS v FROM t UNION ALL SELECT 'month', CASE WHEN pnl > 1e-9 THEN 'winner' WHEN pnl < -1e-9 THEN 'loser' END, CAST(month(ts) AS DOUBLE) FROM t)
SELECT feature, outcome, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75 FROM f WHERE outcome IS NOT NULL GROUP BY 1, 2""")
def winner_loser_profile(spark, d):
    found = M.winner_loser_profile(trades(spark, d).withColumn("month", F.month("ts")), ["price", "month"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p25", "p75")})


@query(f"""WITH {TRADES} SELECT (SELECT count(*) FROM t) AS total, th AS threshold, count(CASE WHEN price >= th THEN 1 END) AS kept, round(coalesce(sum(CASE WHEN price >= th THEN pnl END), 0), 2) AS net FROM t, (SELECT unnest([50000.0::DOUBLE, 100000.0, 200000.0]) AS th) GROUP BY th""")
def threshold_probe(spark, d):
    return M.threshold_probe(trades(spark, d), "price", [50000, 100000, 200000]).withColumn("net", F.round("net", 2))


@query("""WITH s AS (SELECT CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS ordinal, event_type AS stage, count(*) AS entered, CAST(sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)
SELECT stage, entered, passed, ordinal, round(passed * 1.0 / nullif(lag(passed) OVER (ORDER BY ordinal), 0), 6) AS conversion FROM s""")
def funnel(spark, d):
    rows = ticks(spark, d).select(F.col("symbol").alias("stage"), (F.col("raw") > 5).alias("passed"))
    return M.funnel(rows, ["view", "click", "purchase"]).withColumns(r6("conversion"))


@query(f"""WITH {TRADES}, m AS (SELECT strftime(ts, '%Y-%m') AS month, sum(pnl) AS net FROM t GROUP BY 1) SELECT month, round(net, 2) AS net, round(net / (SELECT sum(net) FROM m WHERE net > 0), 6) AS share FROM m ORDER BY m.net DESC, month LIMIT 5""")
def concentration(spark, d):
    return M.concentration(trades(spark, d), "ts").withColumns({"net": F.round("net", 2), "share": F.round("share", 6)})


@query(f"""WITH {TRADES}, y AS (SELECT year(ts) AS dropped, count(pnl) AS n, sum(pnl) AS net FROM t GROUP BY 1) SELECT CAST(dropped AS INTEGER) AS dropped, CAST((SELECT sum(n) FROM y) - n AS BIGINT) AS n, round((SELECT sum(net) FROM y) - net, 2) AS net FROM y""")
def leave_one_out(spark, d):
    return M.leave_one_out(trades(spark, d), F.year("ts")).withColumn("net", F.round("net", 2))


@query(f"""WITH {TRADES}, k AS (SELECT r, row_number() OVER (ORDER BY r DESC, ts, trade_id) AS n FROM t), c AS (SELECT unnest([1, 3, 5]) AS removed)
SELECT CAST(removed AS INTEGER) AS removed, round((SELECT sum(r) FROM k) - (SELECT sum(r) FROM k WHERE n <= removed), 6) AS remaining, round((SELECT sum(r) FROM k WHERE n <= removed) / (SELECT sum(r) FROM k), 6) AS top_share FROM c""")
def outlier_dependence(spark, d):
    return M.outlier_dependence(trades(spark, d), ["ts", "trade_id"]).withColumns(r6("remaining", "top_share"))


@query(f"""WITH {TRADES} SELECT symbol, count(CASE WHEN pnl > 0 THEN 1 END) AS above_0, count(CASE WHEN pnl > 50000 THEN 1 END) AS above_50000, count(CASE WHEN pnl > 100000 THEN 1 END) AS above_100000 FROM t GROUP BY symbol""")
def pivot_population(spark, d):
    rows = trades(spark, d).withColumn("level", F.explode(F.array(F.lit(0), F.lit(50000), F.lit(100000)))).filter(F.col("pnl") > F.col("level"))
    found = rows.groupBy("symbol").pivot("level", [0, 50000, 100000]).count().na.fill(0)
    return found.select("symbol", *[F.col(str(x)).alias(f"above_{x}") for x in (0, 50000, 100000)])


# --- search and resampling


@query("""WITH s AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)
SELECT x.a, x.b, round(x.score, 2) AS score, count(y.a) AS neighbours, round(avg(y.score), 4) AS mean_neighbour, count(CASE WHEN y.score >= 0.8 * x.score THEN 1 END) AS holding
FROM s x LEFT JOIN s y ON round(abs(x.a - y.a) + 100 * abs(x.b - y.b), 6) = 1 GROUP BY 1, 2, x.score""")
def grid_neighbours(spark, d):
    """Highest price of each quantity and discount, and how it holds one step away."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b")).agg(F.max("l_extendedprice").alias("score"))
    rows = rows.withColumn("candidate", F.concat_ws("|", "a", "b"))
    found = V.neighbour_stability(rows, ["a", "b"], {"a": 1.0, "b": 0.01})
    return found.select("a", "b", F.round("score", 2).alias("score"), "neighbours", F.round("mean_neighbour", 4).alias("mean_neighbour"), "holding")


@query(f"""WITH {TRADES}, g AS (SELECT year(ts) AS fold, direction, symbol, sum(r) AS score FROM t GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, direction, symbol) AS n FROM g) SELECT CAST(fold AS INTEGER) AS fold, direction, symbol, round(score, 4) AS score FROM k WHERE n = 1""")
def select_candidate(spark, d):
    rows = trades(spark, d).groupBy(F.year("ts").alias("fold"), "direction", "symbol").agg(F.sum("r").alias("score"))
    return V.select_candidate(rows, ["fold"], [F.desc_nulls_last("score"), "direction", "symbol"]).withColumn("score", F.round("score", 4))


@query(f"""WITH {TRADES}, m AS (SELECT date_trunc('month', min(ts)) AS m0, date_trunc('month', max(ts)) + INTERVAL 1 MONTH AS m1 FROM t),
f AS (SELECT range AS fold, m0 + to_months(CAST(range * 3 AS INTEGER)) AS train_start, m0 + to_months(CAST(range * 3 + 6 AS INTEGER)) AS train_end, m0 + to_months(CAST(range * 3 + 9 AS INTEGER)) AS test_end, m1 FROM range(1000), m),
x AS (SELECT f.fold, CASE WHEN ts < train_end THEN 'train' ELSE 'test' END AS role, r FROM t JOIN f ON ts >= train_start AND ts < test_end WHERE test_end <= m1)
SELECT fold, role, count(*) AS n, round(sum(r), 4) AS total_r FROM x GROUP BY 1, 2""")
def walk_forward_folds(spark, d):
    start, end = month_range(trades(spark, d))
    rows = V.by_fold(trades(spark, d), V.folds(spark, str(start), str(end), 6, 3))
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("total_r"))


@query()
def backtest_next_open(spark, d):
    width = dense_width(spark, d)
    return X.simulate(G.ema_cross(prepared_bars(spark, d, width), SEG, 12), SEG, width)


@query()
def backtest_pending(spark, d):
    width = dense_width(spark, d)
    rows = G.breakout(prepared_bars(spark, d, width), SEG, adx=10.0, body=0.1)
    return X.simulate(rows, SEG, width, X.Settings(commission_percent=0.05))


@query()
def backtest_spread_grid(spark, d):
    width = dense_width(spark, d)
    rows = X.spread_grid(G.breakout(prepared_bars(spark, d, width), SEG, adx=10.0, body=0.1), [0.0, 0.05, 0.1])
    found = X.simulate(rows, [*SEG, "spread"], width)
    return M.trade_stats(found, ["spread"], r="r")
