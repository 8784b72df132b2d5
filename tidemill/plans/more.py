"""More queries: audits, comparisons, replays, grouped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import candles as cx
from tidemill.operators import audits as A
from tidemill.operators import bars as B
from tidemill.operators import compare as C
from tidemill.operators import joins as J
from tidemill.operators import metrics as M
from tidemill.operators import replay as P
from tidemill.operators import reports as D
from tidemill.operators import segments as S
from tidemill.plans.queries import EQUITY, FEEDS, KEY, SEG, STATS, TRADES, W1, _rounded, bars, bars_sql, feeds, month_range, positions, query, r6, seg_sql, series, table, ticks, trades


@query(f"""WITH {bars_sql()}, n AS (SELECT symbol, ts, count(*) AS n FROM b GROUP BY 1, 2), q AS (SELECT symbol, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_ts FROM n GROUP BY 1)
SELECT b.symbol, count(*) AS n_rows, 0::BIGINT AS null_open, 0::BIGINT AS null_high, 0::BIGINT AS null_low, 0::BIGINT AS null_close, 0::BIGINT AS null_volume, 0::BIGINT AS invalid, 0::BIGINT AS inverted,
 count(CASE WHEN high = low THEN 1 END) AS flat, 0::BIGINT AS no_volume, 0::BIGINT AS off_grid, min(ts) AS first_ts, max(ts) AS last_ts, any_value(repeated_ts) AS repeated_ts, true AS passed FROM b JOIN q ON b.symbol = q.symbol GROUP BY b.symbol""")
def candle_audit(spark, d):
    return A.candle_audit(bars(spark, d), KEY)


@query("""WITH e AS (SELECT event_type AS symbol, event_id, time_bucket(interval '15 minutes', ts) AS ts FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY event_id) AS p FROM e), u AS (SELECT DISTINCT symbol, ts FROM e), g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM u),
a AS (SELECT symbol, count(*) AS n_rows, count(DISTINCT ts) AS n_ts, count(CASE WHEN ts < p THEN 1 END) AS reversals FROM l GROUP BY 1), c AS (SELECT symbol, count(CASE WHEN epoch(ts) - epoch(p) <> 900 THEN 1 END) AS gaps FROM g GROUP BY 1)
SELECT a.symbol, n_rows, n_ts, reversals, gaps, n_rows - n_ts AS duplicates FROM a JOIN c ON a.symbol = c.symbol""")
def log_audit(spark, d):
    rows = ticks(spark, d).select("symbol", "event_id", B.bucket("ts", 900).alias("ts"))
    return A.log_audit(rows, KEY, "event_id", 900)


@query(f"""WITH {seg_sql('15 minutes', 900)}, n AS (SELECT *, lead(segment_start) OVER (PARTITION BY symbol ORDER BY segment_start) AS nx FROM seg),
g AS (SELECT symbol, segment_end, nx, segment_end + interval '15 minutes' AS gap_start FROM n WHERE nx IS NOT NULL)
SELECT symbol, CASE WHEN isodow(gap_start) = 7 AND isodow(nx) = 1 THEN 'SESSION_GAP' WHEN segment_end >= TIMESTAMP '2024-01-10' AND nx <= TIMESTAMP '2024-01-20' THEN 'REPLAY_DATA_GAP' ELSE 'MISSING_DATA_GAP' END AS kind, count(*) AS n FROM g GROUP BY 1, 2""")
def gap_classes(spark, d):
    step = F.expr("interval 15 minutes")
    gaps = S.missing_gaps(S.segments(bars(spark, d), KEY), KEY)
    before, after = F.col("gap_start") - step, F.col("gap_start") + F.make_dt_interval(secs=F.col("missing") * 900)
    session = (F.weekday("gap_start") == 6) & (F.weekday(after) == 0)
    kind = A.gap_class(before, after, 900, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), session)
    return gaps.groupBy("symbol", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {seg_sql()} SELECT *, CASE WHEN candles > 12 AND candles - 12 >= 6 THEN segment_start + interval '12 hours' END AS trade_start,
 CASE WHEN candles <= 12 THEN 'shorter than warm-up' WHEN candles - 12 < 6 THEN 'too few bars after warm-up' END AS excluded, candles > 12 AND candles - 12 >= 6 AS usable FROM seg""")
def usable_segments(spark, d):
    return A.usable_segments(bars(spark, d, 3600), KEY, 12, 6, 3600)


@query(f"""WITH {bars_sql()}, m AS (SELECT max(ts) AS now FROM b) SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM b, m WHERE ts + interval '15 minutes' <= now GROUP BY symbol""")
def finished_bars(spark, d):
    rows = bars(spark, d)
    now = rows.agg(F.max("ts").alias("_now"))
    return A.finished(rows.crossJoin(F.broadcast(now)), F.col("_now")).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query(f"""WITH {FEEDS}, j AS (SELECT l.ts, l.close AS a, r.close AS b FROM l JOIN r ON l.ts = r.ts) SELECT count(*) AS n, round(corr(a, b), 6) AS level, round(avg(abs(a - b)), 6) AS mean_gap, round(avg(abs(a - b) / a), 6) AS mean_gap_share FROM j""")
def feed_similarity(spark, d):
    return C.feed_similarity(*feeds(spark, d)).withColumns(r6("level", "mean_gap", "mean_gap_share"))


VERSIONS = "x AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders), y AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price, max(l_linestatus) AS status FROM lineitem GROUP BY 1)"


def versions(spark, d):
    """Two versions of the orders: as their table has them, and as their lines add up."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price")
    return rows, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(price, F.max("l_linestatus").alias("status"))


@query(f"""WITH {VERSIONS}, j AS (SELECT coalesce(x.k, y.k) AS k, x.k AS xk, y.k AS yk, x.price AS p, y.price AS q, x.status AS s, y.status AS t FROM x FULL JOIN y ON x.k = y.k),
u AS (SELECT k, CASE WHEN yk IS NULL THEN 'removed' WHEN xk IS NULL THEN 'added' ELSE 'changed' END AS change, 'price' AS field FROM j WHERE p IS DISTINCT FROM q UNION ALL SELECT k, CASE WHEN yk IS NULL THEN 'removed' WHEN xk IS NULL THEN 'added' ELSE 'changed' END, 'status' FROM j WHERE s IS DISTINCT FROM t)
SELECT change, field, count(*) AS n FROM u GROUP BY 1, 2""")
def revision_diff(spark, d):
    return C.revision_diff(*versions(spark, d), ["k"], ["price", "status"]).groupBy("change", "field").agg(F.count("*").alias("n"))


@query(f"""WITH {VERSIONS}, j AS (SELECT x.k, CASE WHEN abs(x.price - y.price) > 0.5 THEN 'price' WHEN x.status <> y.status THEN 'status' END AS divergence FROM x JOIN y ON x.k = y.k) SELECT divergence, count(*) AS n FROM j GROUP BY 1""")
def audit_first_divergence(spark, d):
    found = C.first_divergence(*versions(spark, d), ["k"], {"price": (0.5, 0.0), "status": (0.0, 0.0)})
    return found.groupBy("divergence").agg(F.count("*").alias("n"))


@query(f"""WITH {VERSIONS} SELECT count(*) AS compared, 'price' AS "column", count(CASE WHEN abs(x.price - y.price) <= 0.5 THEN 1 END) AS agree FROM x JOIN y ON x.k = y.k UNION ALL SELECT count(*), 'status', count(CASE WHEN x.status = y.status THEN 1 END) FROM x JOIN y ON x.k = y.k""")
def audit_agreement(spark, d):
    return C.agreement(*versions(spark, d), ["k"], {"price": (0.5, 0.0), "status": (0.0, 0.0)})


@query(f"""WITH {VERSIONS}, j AS (SELECT y.price - x.price AS delta FROM x JOIN y ON x.k = y.k) SELECT 'price' AS field, count(delta) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, round(quantile_cont(abs(delta), 0.95), 6) AS p95_abs, round(max(abs(delta)), 6) AS largest FROM j""")
def price_effects(spark, d):
    return C.price_effects(*versions(spark, d), ["k"], ["price"]).withColumns(r6("mean", "median", "p95_abs", "largest"))


@query()
def greedy_match(spark, d):
    rows = ticks(spark, d).filter("symbol = 'click'").select("user_id", "ts", F.col("event_id").alias("id"))
    other = ticks(spark, d).filter("symbol = 'view'").select("user_id", "ts", F.col("event_id").alias("id"))
    return C.greedy_match(rows, other, ["user_id"], 6 * 3600)


def levels(spark, d) -> DataFrame:
    """Positions with a stop and a target 15 away."""
    rows = positions(spark, d)
    sign = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    return rows.withColumns({"stop": F.col("entry") - sign * 15, "target": F.col("entry") + sign * 15})


LEVELS = "p AS (SELECT event_type AS symbol, event_id AS trade_id, user_id % 2 = 0 AS long, ts AS entry_ts, ts + interval '3 hours' AS exit_ts, value + 100 AS entry FROM events)"


@query(f"""WITH {LEVELS}, q AS (SELECT event_type AS symbol, ts, event_id AS seq, value + 100 AS bid, value + 100.5 AS ask FROM events),
x AS (SELECT p.trade_id, q.ts, q.seq, CASE WHEN long THEN bid <= entry - 15 ELSE ask >= entry + 15 END AS s, CASE WHEN long THEN bid >= entry + 15 ELSE ask <= entry - 15 END AS t FROM p JOIN q ON p.symbol = q.symbol AND q.ts BETWEEN entry_ts AND exit_ts),
a AS (SELECT trade_id, min(CASE WHEN s THEN ts END) AS st, min(CASE WHEN t THEN ts END) AS tt, count(*) AS quotes FROM x GROUP BY 1)
SELECT p.trade_id, CASE WHEN st IS NULL AND tt IS NULL THEN 'NONE' WHEN tt IS NULL OR st < tt THEN 'STOP' WHEN st IS NULL OR tt < st THEN 'TARGET' ELSE 'AMBIGUOUS' END AS touch, least(st, tt) AS touch_ts, coalesce(quotes, 0) AS quotes FROM p LEFT JOIN a ON p.trade_id = a.trade_id""")
def quote_first_touch(spark, d):
    quotes = ticks(spark, d).select("symbol", "ts", F.col("event_id").alias("seq"), F.col("price").alias("bid"), (F.col("price") + 0.5).alias("ask"))
    return P.first_touch(levels(spark, d), quotes, KEY)


@query(f"""WITH {LEVELS}, {bars_sql()}, x AS (SELECT DISTINCT p.trade_id FROM p JOIN b ON p.symbol = b.symbol AND b.ts BETWEEN entry_ts AND exit_ts)
SELECT (SELECT count(*) FROM p) AS trades, (SELECT count(*) FROM x) AS covered, round((SELECT count(*) FROM x) * 1.0 / (SELECT count(*) FROM p), 6) AS share""")
def replay_coverage(spark, d):
    return P.coverage(levels(spark, d), bars(spark, d), KEY).withColumns(r6("share"))


@query()
def exit_models(spark, d):
    models = [("2R", 2.0, None, 0.0), ("3R", 3.0, None, 0.0), ("2R breakeven", 2.0, 1.0, 0.0), ("3R half", 3.0, None, 0.5)]
    return P.exit_models(levels(spark, d), bars(spark, d), KEY, models, 86_400)


@query(f"""WITH {seg_sql()}, n AS (SELECT *, row_number() {W1}) AS k FROM s), g AS (SELECT unnest([10.0::DOUBLE, 20.0, 30.0]) AS target),
p AS (SELECT a.symbol, a.segment_id, a.ts, g.target / 10 AS target_r, min(CASE WHEN z.high >= a.close + g.target THEN z.k END) - a.k AS u, min(CASE WHEN z.low <= a.close - 10 THEN z.k END) - a.k AS w
 FROM n a CROSS JOIN g LEFT JOIN n z ON a.symbol = z.symbol AND a.segment_id = z.segment_id AND z.k BETWEEN a.k + 1 AND a.k + 24 GROUP BY a.symbol, a.segment_id, a.ts, a.k, g.target),
c AS (SELECT target_r, count(CASE WHEN u IS NOT NULL AND (w IS NULL OR u < w) THEN 1 END) AS target, count(CASE WHEN w IS NOT NULL AND (u IS NULL OR w < u) THEN 1 END) AS stop, count(CASE WHEN u = w THEN 1 END) AS ambiguous, count(CASE WHEN u IS NULL AND w IS NULL THEN 1 END) AS open FROM p GROUP BY 1)
SELECT *, round(target * 1.0 / nullif(target + stop, 0), 6) AS win_rate, round((target * target_r - stop) / nullif(target + stop, 0), 6) AS expectancy_r, round(1 / (1 + target_r), 6) AS needed_rate FROM c""")
def payoff_curve(spark, d):
    rows = series(spark, d)
    parts = [J.first_passage(rows, SEG, t, 10.0, 24).select(F.lit(t / 10).alias("target_r"), "resolution") for t in (10.0, 20.0, 30.0)]
    return P.payoff_curve(parts[0].union(parts[1]).union(parts[2])).withColumns(r6("win_rate", "expectancy_r", "needed_rate"))


@query(f"""WITH {TRADES}, {EQUITY}, s AS (SELECT year(ts) AS y, max(round(peak - balance, 2)) AS max_drawdown FROM q GROUP BY 1), g AS (SELECT CAST(year(ts) AS INTEGER) AS year, {STATS} FROM t GROUP BY 1) SELECT g.*, s.max_drawdown FROM g JOIN s ON g.year = s.y""")
def yearly_pooled(spark, d):
    return _rounded(D.by_period(trades(spark, d), KEY, F.year("ts"), "year", ["ts", "trade_id"], 1e7)).withColumn("max_drawdown", F.round("max_drawdown", 2))


@query(f"""WITH {TRADES} SELECT CASE WHEN grouping(year(ts)) = 1 THEN 'All' ELSE CAST(year(ts) AS VARCHAR) END AS year, CASE WHEN grouping(direction) = 1 THEN 'All' ELSE direction END AS direction, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median,
 round(avg(CASE WHEN r >= 1 THEN 1.0 ELSE 0.0 END), 6) AS reach_1, round(avg(CASE WHEN r >= 2 THEN 1.0 ELSE 0.0 END), 6) AS reach_2 FROM t GROUP BY CUBE (year(ts), direction)""")
def excursion_cube(spark, d):
    return D.reach_cube(trades(spark, d).withColumn("year", F.year("ts").cast("string")), ["year", "direction"], "r", [1, 2]).withColumns(r6("median", "reach_1", "reach_2"))


@query(f"""WITH {TRADES}, g AS (SELECT unnest([0.0::DOUBLE, 10.0, 20.0]) AS spread), x AS (SELECT spread, year(ts) AS year, pnl - spread * 100 AS pnl FROM t, g) SELECT spread, CAST(year AS INTEGER) AS year, {STATS} FROM x GROUP BY 1, 2""")
def cost_sensitivity(spark, d):
    return _rounded(D.cost_grid(trades(spark, d).withColumns({"year": F.year("ts"), "quantity": F.lit(100.0)}), [0.0, 10.0, 20.0], ["year"]))


@query(f"""WITH {TRADES}, k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r, trade_id) AS n, count(*) OVER (PARTITION BY symbol) AS m FROM t) SELECT symbol, round(avg(r), 6) AS tail_mean, count(*) AS n FROM k WHERE n <= ceil(m * 0.05) GROUP BY 1""")
def tail_loss(spark, d):
    return D.tail_loss(trades(spark, d), KEY, "r").withColumns(r6("tail_mean"))


@query(f"""WITH {TRADES}, f AS (SELECT symbol, CASE WHEN pnl > 1e-9 THEN price END AS w, CASE WHEN pnl < -1e-9 THEN price END AS l, price FROM t) SELECT symbol, 'price' AS feature, round(abs(quantile_cont(w, 0.5) - quantile_cont(l, 0.5)) / nullif(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 0), 6) AS effect FROM f GROUP BY 1""")
def effect_size(spark, d):
    return D.effect_sizes(trades(spark, d), KEY, ["price"]).withColumns(r6("effect"))


@query(f"""WITH {TRADES}, m AS (SELECT direction, strftime(ts, '%Y-%m') AS month, sum(r) AS s FROM t GROUP BY 1, 2), c AS (SELECT *, lag(s) OVER (PARTITION BY direction ORDER BY month) AS p FROM m) SELECT direction, count(*) AS months, count(CASE WHEN s > 0 THEN 1 END) AS positive, round(avg(abs(s - p)), 4) AS mean_change FROM c GROUP BY 1""")
def parameter_drift(spark, d):
    rows = trades(spark, d).groupBy("direction", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("r").alias("s"))
    return D.drift(rows, ["direction"], "month", "s").withColumn("mean_change", F.round("mean_change", 4))


@query(f"""WITH {bars_sql('1 hour')}, g AS (SELECT unnest([1, 2, 4, 8]) AS h), x AS (SELECT g.h, avg(abs(c.close - b.close)) AS m FROM b JOIN g ON true JOIN b c ON b.symbol = c.symbol AND c.ts = b.ts + to_hours(g.h) GROUP BY 1) SELECT round(regr_slope(ln(m), ln(h)), 5) AS exponent, round(regr_intercept(ln(m), ln(h)), 5) AS intercept FROM x""")
def move_scaling(spark, d):
    return D.move_scaling(bars(spark, d, 3600), KEY, [1, 2, 4, 8], 3600).select(F.round("exponent", 5).alias("exponent"), F.round("intercept", 5).alias("intercept"))


@query(f"""WITH {TRADES}, m AS (SELECT date_trunc('month', min(ts)) AS m0, date_diff('month', min(ts), max(ts)) + 1 AS k FROM t), w AS (SELECT m0 + to_months(CAST(i AS INTEGER)) AS a, m0 + to_months(CAST(i + 3 AS INTEGER)) AS z FROM (SELECT m0, unnest(range(k)) AS i FROM m)) SELECT a AS window_start, count(*) AS n, round(sum(r), 4) AS total_r FROM t JOIN w ON ts >= a AND ts < z GROUP BY 1""")
def rolling_calendar(spark, d):
    start, end = month_range(trades(spark, d))
    months = (end.year - start.year) * 12 + end.month - start.month
    return D.rolling_months(trades(spark, d), str(start), months, 3).withColumn("total_r", F.round("total_r", 4))


@query("""WITH s AS (SELECT event_type AS symbol, list_sort(list(abs(value - 50))) AS v FROM events GROUP BY 1) SELECT symbol, len(v) AS n, round(v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1], 6) AS p95, round(v[len(v)], 6) AS worst FROM s""")
def nearest_rank(spark, d):
    return D.nearest_rank(ticks(spark, d), KEY, F.abs(F.col("raw") - 50)).withColumns(r6("p95", "worst"))


@query("""SELECT event_type AS symbol, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 4 AS bucket, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def event_census(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy(F.col("event_type").alias("symbol"), (F.col("k") % 4).alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("high"), F.count_distinct("user_id").alias("users"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_totalprice <> 0 THEN round((o_totalprice + 5 - o_totalprice) / abs(o_totalprice) * 100, 6) END AS change, CASE WHEN o_orderpriority LIKE '1%' THEN 'first' WHEN contains(o_orderpriority, 'LOW') THEN 'low' ELSE 'other' END AS kind,
 concat_ws('; ', CASE WHEN o_totalprice < 100000 THEN 'small' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END) AS warnings FROM orders""")
def candidate_filters(spark, d):
    rows = table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "first").when(F.col("o_orderpriority").contains("LOW"), "low").otherwise("other")
    warnings = F.concat_ws("; ", F.when(F.col("o_totalprice") < 100000, "small"), F.when(F.col("o_orderstatus") == "F", "closed"))
    return rows.select(F.col("o_orderkey").alias("k"), F.round(cx.change_percent(F.col("o_totalprice"), F.col("o_totalprice") + 5), 6).alias("change"), kind.alias("kind"), warnings.alias("warnings"))


@query(f"WITH {bars_sql('1 hour')}, n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) SELECT symbol, ts, close FROM n WHERE k <= 100")
def tail_window(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("symbol").orderBy(F.desc("ts"))  # the feature: a chart's last 100 bars
    return bars(spark, d, 3600).withColumn("_k", F.row_number().over(order)).filter("_k <= 100").select("symbol", "ts", "close")


@query("""SELECT l_returnflag AS symbol, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(corr(l_extendedprice, l_quantity), 6) AS strength FROM lineitem GROUP BY 1, 2""")
def monthly_rollup(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("strength"))


@query("""SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def dimension_lookup(spark, d):
    orders, customer, nation = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def streaks_keep_breakeven(spark, d):
    return M.streaks(trades(spark, d), KEY, ["ts", "trade_id"], breakeven_resets=False)
