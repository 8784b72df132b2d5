"""Queries of walk-forward validation, structural events, pairing and fills, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import events as E
from tidemill.operators import search as V
from tidemill.operators import walk as W
from tidemill.plans.queries import KEY, TRADES, bars_sql, month_range, query, r6, series, table, trades

PARAMS = {"a": (1, 7), "b": (1, 3)}
POLICY = W.Policy(minimum_trades=3, minimum_profit_factor=0.5)
LINES = """l AS (SELECT l_linenumber || '|' || CAST(ceil(l_quantity / 17) AS INTEGER) AS candidate, CAST(l_linenumber AS DOUBLE) AS a, ceil(l_quantity / 17) AS b, CAST(l_shipdate AS TIMESTAMP) AS ts,
 l_orderkey * 10 + l_linenumber AS trade_id, l_returnflag AS flag, round(l_extendedprice - 38000, 2) AS pnl, round(l_extendedprice - 38000, 2) / 10000 AS r FROM lineitem)"""


def measured_sql(keys: str, source: str) -> str:
    return f"""w AS (SELECT *, 1000000 + sum(pnl) OVER (PARTITION BY {keys} ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS bal FROM {source}),
v AS (SELECT *, greatest(1000000, max(bal) OVER (PARTITION BY {keys} ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM w),
k AS (SELECT {keys}, count(*) AS total_trades, sum(CASE WHEN pnl > 1e-9 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl < -1e-9 THEN pnl ELSE 0 END), 0) AS profit_factor, avg(r) AS average_r, sum(pnl) AS pnl,
 max((peak - bal) * 100 / peak) AS max_drawdown FROM v GROUP BY ALL)"""


def stability_sql(source: str, key: str) -> str:
    return f"""nb AS (SELECT x.{key}, x.candidate, count(*) AS neighbors, count(CASE WHEN y.pnl > 0 THEN 1 END) * 100.0 / count(*) AS profitable_percent, count(CASE WHEN y.average_r > 0 THEN 1 END) * 100.0 / count(*) AS positive_r_percent,
 quantile_cont(y.profit_factor, 0.5) AS median_pf, quantile_cont(y.average_r, 0.5) AS median_r, quantile_cont(y.max_drawdown, 0.5) AS median_drawdown, stddev_pop(y.profit_factor) AS pf_spread
 FROM {source} x JOIN {source} y ON x.{key} = y.{key} AND x.candidate <> y.candidate AND (x.a = y.a OR x.b = y.b) GROUP BY 1, 2),
st AS (SELECT x.*, coalesce(neighbors, 0) AS neighbors, profitable_percent, positive_r_percent, median_pf, median_r, median_drawdown, coalesce(pf_spread, 0) AS pf_spread,
 0.4 * profitable_percent + 0.4 * positive_r_percent + 0.2 * (100 - least(coalesce(nullif(median_drawdown, 0), 100), 100)) AS stability_score,
 CASE WHEN neighbors IS NULL THEN 'Insufficient Neighbors' WHEN least(profitable_percent, positive_r_percent) >= 75 THEN 'Broad Plateau' WHEN least(profitable_percent, positive_r_percent) >= 50 THEN 'Moderate Stability' ELSE 'Fragile Region' END AS classification,
 concat_ws('; ', CASE WHEN profit_factor > median_pf * 1.5 THEN 'ISOLATED PEAK PATTERN' END, CASE WHEN a IN (1, 7) OR b IN (1, 3) THEN 'BOUNDARY SENSITIVITY' END, CASE WHEN pf_spread > greatest(abs(median_pf) * 0.5, 0.25) THEN 'FRAGILITY WARNING: UNSTABLE NEIGHBORING RESULTS' END) AS warnings
 FROM {source} x LEFT JOIN nb ON x.{key} = nb.{key} AND x.candidate = nb.candidate)"""


FOLDS = """m AS (SELECT date_trunc('month', min(ts)) AS m0, date_trunc('month', max(ts)) + INTERVAL 1 MONTH AS m1 FROM {0}),
f AS (SELECT range AS fold, m0 + to_months(CAST(range * 3 AS INTEGER)) AS train_start, m0 + to_months(CAST(range * 3 + 6 AS INTEGER)) AS train_end, m0 + to_months(CAST(range * 3 + 9 AS INTEGER)) AS test_end FROM range(1000), m WHERE m0 + to_months(CAST(range * 3 + 9 AS INTEGER)) <= m1)"""
WALK = f"""{LINES}, {FOLDS.format("l")}, x AS (SELECT fold, CASE WHEN ts < train_end THEN 'train' ELSE 'test' END AS role, l.* FROM l JOIN f ON ts >= train_start AND ts < test_end), {measured_sql("fold, role, candidate", "x")},
c AS (SELECT DISTINCT candidate, a, b FROM l), tr AS (SELECT f.fold, c.*, coalesce(total_trades, 0) AS total_trades, profit_factor, coalesce(average_r, 0) AS average_r, coalesce(pnl, 0) AS pnl, coalesce(max_drawdown, 0) AS max_drawdown FROM f CROSS JOIN c LEFT JOIN k ON k.fold = f.fold AND k.candidate = c.candidate AND role = 'train'),
{stability_sql("tr", "fold")}, ok AS (SELECT *, contains(warnings, 'ISOLATED') AS lone FROM st WHERE total_trades >= 3 AND profit_factor >= 0.5 AND average_r >= 0),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY fold ORDER BY lone, list_position(['Broad Plateau', 'Moderate Stability', 'Fragile Region', 'Insufficient Neighbors'], classification), stability_score DESC NULLS LAST, median_r DESC NULLS LAST, average_r DESC NULLS LAST, profit_factor DESC NULLS LAST, max_drawdown, candidate) = 1),
walked AS (SELECT f.fold, f.train_start, f.train_end, f.test_end, best.* EXCLUDE (fold), coalesce(k.total_trades, CASE WHEN best.candidate IS NOT NULL THEN 0 END) AS test_total_trades, coalesce(k.pnl, CASE WHEN best.candidate IS NOT NULL THEN 0 END) AS test_pnl, k.profit_factor AS test_profit_factor,
 CASE WHEN best.candidate IS NULL THEN 'NO_SELECTION' ELSE 'SELECTED' END AS status FROM f LEFT JOIN best ON f.fold = best.fold LEFT JOIN k ON k.fold = f.fold AND k.candidate = best.candidate AND role = 'test')"""


def lines(spark, d):
    """Lines of orders as trades of candidates: parameters are the line's number and a class of its quantity."""
    b = F.ceil(F.col("l_quantity") / 17)
    pnl = F.round(F.col("l_extendedprice") - 38000, 2)
    return table(spark, d, "lineitem").select(
        F.concat_ws("|", "l_linenumber", b.cast("int")).alias("candidate"), F.col("l_linenumber").cast("double").alias("a"), b.cast("double").alias("b"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.col("l_returnflag").alias("flag"), pnl.alias("pnl"), (pnl / 10000).alias("r"),
    )


def rated(spark, d):
    """Candidates with metrics, by flag."""
    rows = lines(spark, d)
    return W.measured(rows, ["flag", "candidate", "a", "b"], ["ts", "trade_id"], 1e6)


@query(f"""WITH {LINES}, {measured_sql("flag, candidate, a, b", "l")}, {stability_sql("k", "flag")} SELECT flag, candidate, neighbors, round(profitable_percent, 4) AS profitable_percent, round(positive_r_percent, 4) AS positive_r_percent, round(median_pf, 6) AS median_pf, round(median_r, 6) AS median_r,
 round(median_drawdown, 6) AS median_drawdown, round(pf_spread, 6) AS pf_spread, round(stability_score, 4) AS stability_score, classification, warnings FROM st""")
def candidate_stability(spark, d):
    found = W.stability(rated(spark, d), PARAMS, ["flag"])
    fours = {n: F.round(n, 4) for n in ("profitable_percent", "positive_r_percent", "stability_score")}
    found = found.withColumns({**fours, **r6("median_pf", "median_r", "median_drawdown", "pf_spread"), "warnings": F.concat_ws("; ", "warnings")})
    return found.select("flag", "candidate", "neighbors", *fours, "median_pf", "median_r", "median_drawdown", "pf_spread", "classification", "warnings")


def walked(spark, d):
    rows = lines(spark, d)
    start, end = month_range(rows)
    return W.walk_forward(rows, rows.select("candidate", "a", "b").distinct(), V.folds(spark, str(start), str(end), 6, 3), PARAMS, ["ts", "trade_id"], POLICY, 1e6)


@query(f"""WITH {WALK} SELECT fold, train_start, train_end, test_end, status, candidate, classification, total_trades, round(average_r, 6) AS average_r, round(max_drawdown, 6) AS max_drawdown, test_total_trades, round(test_pnl, 2) AS test_pnl,
 round(CASE WHEN profit_factor <> 0 THEN (test_profit_factor - profit_factor) / abs(profit_factor) * 100 END, 4) AS pf_degradation_percent FROM walked""")
def walk_forward(spark, d):
    found = walked(spark, d).withColumns({**r6("average_r", "max_drawdown"), "test_pnl": F.round("test_pnl", 2), "pf_degradation_percent": F.round("pf_degradation_percent", 4)})
    return found.select("fold", "train_start", "train_end", "test_end", "status", "candidate", "classification", "total_trades", "average_r", "max_drawdown", "test_total_trades", "test_pnl", "pf_degradation_percent")


@query(f"""WITH {WALK}, p AS (SELECT fold, 'a' AS parameter, a AS v FROM walked WHERE status = 'SELECTED' UNION ALL SELECT fold, 'b', b FROM walked WHERE status = 'SELECTED'), s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY parameter ORDER BY fold)) AS step FROM p)
SELECT parameter, count(*) AS folds, count(DISTINCT v) > 1 AS changed, coalesce(sum(step), 0.0) AS distance FROM s GROUP BY 1""")
def selected_drift(spark, d):
    return W.selected_drift(walked(spark, d), ["a", "b"])


@query(f"""WITH {TRADES}, dd AS (SELECT DISTINCT symbol, ts FROM t), {FOLDS.format("dd")}, x AS (SELECT symbol, fold, ts, ts < train_end AS tr FROM dd JOIN f ON ts >= train_start AND ts < test_end),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold, tr ORDER BY ts) AS i, row_number() OVER (PARTITION BY symbol, fold, tr ORDER BY ts DESC) AS z FROM x),
g AS (SELECT symbol, fold, count(CASE WHEN tr THEN 1 END) AS training, count(CASE WHEN tr AND z <= 20 THEN 1 END) AS warmup, count(CASE WHEN NOT tr THEN 1 END) AS validation, count(CASE WHEN NOT tr AND i > 5 THEN 1 END) AS eligible, max(CASE WHEN tr THEN ts END) AS training_end,
 min(CASE WHEN tr AND z <= 20 THEN ts END) AS warmup_start, min(CASE WHEN NOT tr AND i > 5 THEN ts END) AS validation_start FROM n GROUP BY 1, 2)
SELECT *, CASE WHEN training < 20 THEN 'has ' || training || ' training bars, requires 20' WHEN validation < 10 THEN 'has ' || validation || ' validation bars, requires 10' WHEN eligible = 0 THEN 'no validation bars remaining after embargo'
 WHEN NOT coalesce(training_end < validation_start, false) THEN 'TRAINING DATA DOES NOT PRECEDE VALIDATION TRADE-ELIGIBLE DATA' END AS fault FROM g""")
def fold_integrity(spark, d):
    rows = trades(spark, d)
    start, end = month_range(rows)
    used = W.fold_bars(rows.select("symbol", "ts").distinct(), V.folds(spark, str(start), str(end), 6, 3), KEY, 5, 20)
    return W.fold_integrity(used, KEY, 20, 10)


@query(f"""WITH {LINES}, k AS (SELECT flag, candidate, count(*) AS total_trades, avg(r) AS average_r FROM l GROUP BY 1, 2) SELECT x.candidate, x.total_trades AS development_total_trades, y.total_trades AS validation_total_trades, round(x.average_r, 6) AS development_average_r, round(y.average_r, 6) AS validation_average_r,
 round((x.total_trades - y.total_trades) / x.total_trades * 100, 4) AS total_trades_loss_percent, round(CASE WHEN x.average_r <> 0 THEN (x.average_r - y.average_r) / abs(x.average_r) * 100 END, 4) AS average_r_loss_percent FROM k x JOIN k y ON x.candidate = y.candidate AND x.flag = 'N' AND y.flag = 'R'""")
def validation_comparison(spark, d):
    rows = rated(spark, d)
    found = W.validation_comparison(rows.filter("flag = 'N'"), rows.filter("flag = 'R'"), ["candidate"])
    found = found.withColumns({**r6("development_average_r", "validation_average_r"), **{n: F.round(n, 4) for n in ("total_trades_loss_percent", "average_r_loss_percent")}})
    return found.select("candidate", "development_total_trades", "validation_total_trades", "development_average_r", "validation_average_r", "total_trades_loss_percent", "average_r_loss_percent")


@query(f"""WITH {LINES}, v AS (SELECT flag, a, sum(CASE WHEN pnl > 1e-9 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl < -1e-9 THEN pnl ELSE 0 END), 0) AS pf, avg(r) AS r, count(*) < 100 AS low, count(*) / 10.0 AS kept FROM l GROUP BY 1, 2),
g AS (SELECT *, coalesce(pf > 0.9 AND r > -0.05, false) AS better, coalesce(pf - lag(pf) OVER w >= -1e-9 AND r - lag(r) OVER w >= -1e-9, false) OR lag(a) OVER w IS NULL AS up FROM v WINDOW w AS (PARTITION BY flag ORDER BY a)),
h AS (SELECT *, better AND lag(better) OVER (PARTITION BY flag ORDER BY a) AS adj FROM g WHERE a <> 4),
s AS (SELECT flag, count(*) AS varied, count(CASE WHEN better THEN 1 END) AS better, avg(CASE WHEN better THEN CAST(low AS INTEGER) END) AS low, quantile_cont(CASE WHEN better THEN kept END, 0.5) AS kept, coalesce(bool_or(adj), false) AS adj FROM h GROUP BY 1), u AS (SELECT flag, bool_and(up) AS up FROM g GROUP BY 1)
SELECT flag, varied, better, CASE WHEN varied = 0 THEN 'No varied settings' WHEN better = 0 THEN 'No joint PF and average-R improvement' WHEN better = 1 THEN 'POSSIBLE OVERFIT: isolated single-value improvement' WHEN low >= 0.5 OR kept < 50 THEN 'Improvement largely coincides with collapsing trade count'
 WHEN better = varied AND up THEN 'Broad monotonic improvement across tested values' WHEN adj THEN 'Stable adjacent-value plateau; not necessarily monotonic' ELSE 'Unstable/non-monotonic behavior' END AS trend FROM s JOIN u USING (flag)""")
def factor_trend(spark, d):
    rows = W.measured(lines(spark, d), ["flag", "a"], ["ts", "trade_id"], 1e6)
    rows = rows.withColumns({"low_sample": F.col("total_trades") < 100, "retention_percent": F.col("total_trades") / 10.0})
    return W.factor_trend(rows, ["flag"], "a", {"profit_factor": 0.9, "average_r": -0.05}, 4.0)


def side_sql(side: int) -> str:
    """Breaks, retests and reclaims of one side, in columns with that side's number."""
    level, gt, near = (("ph", ">", "low <= lv0 + 0.1 * atr"), ("pl", "<", "high >= lv1 - 0.1 * atr"))[side]
    return f"""a{side} AS (SELECT *, coalesce(close {gt} {level}, false) AS k{side} FROM {"q" if side == 0 else "d0"}),
b{side} AS (SELECT *, lag(CASE WHEN k{side} THEN {level} END) OVER w AS was{side}, max(CASE WHEN k{side} THEN n END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fr{side}, last_value(CASE WHEN k{side} THEN {level} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lv{side} FROM a{side} WINDOW w AS (PARTITION BY symbol ORDER BY n)),
c{side} AS (SELECT *, min(CASE WHEN atr > 0 AND n - fr{side} <= 6 AND {near} THEN n END) OVER (PARTITION BY symbol, fr{side}) AS te{side} FROM b{side}),
d{side} AS (SELECT *, min(CASE WHEN atr > 0 AND n - fr{side} <= 6 AND n > te{side} AND close {gt} open AND close {gt} lv{side} THEN n END) OVER (PARTITION BY symbol, fr{side}) AS ba{side} FROM c{side})"""


@query(f"""WITH {bars_sql("1 hour")}, r AS (SELECT *, (high + low) / 2 AS fast, (open + close) / 2 AS slow, (high - low) * 0.8 AS atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b),
q AS (SELECT *, sign(fast - slow) AS stk, lag(sign(fast - slow)) OVER w AS old, CASE WHEN n > 20 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS ph, CASE WHEN n > 20 THEN min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS pl,
 CASE WHEN n > 8 THEN max(high) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END AS sh, CASE WHEN n > 8 THEN min(low) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END AS sl FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)), {side_sql(0)}, {side_sql(1)},
e AS (SELECT symbol, unnest([CASE WHEN was0 > close THEN 'FAILED_BREAKOUT_REVERSAL_DOWN' END, CASE WHEN was1 < close THEN 'FAILED_BREAKDOWN_REVERSAL_UP' END, CASE WHEN k0 THEN 'BREAKOUT_UP' END, CASE WHEN k1 THEN 'BREAKDOWN' END, CASE WHEN n = te0 THEN 'RETEST_AFTER_BREAKOUT_UP' END, CASE WHEN n = te1 THEN 'RETEST_AFTER_BREAKDOWN' END,
 CASE WHEN n = ba0 THEN 'RECLAIM_CONTINUATION_UP' END, CASE WHEN n = ba1 THEN 'RECLAIM_CONTINUATION_DOWN' END, CASE WHEN high > sh AND close < sh THEN 'SWEEP_REJECTION_UP' END, CASE WHEN low < sl AND close > sl THEN 'SWEEP_REJECTION_DOWN' END, CASE WHEN old <= 0 AND stk > 0 THEN 'EMA20_CROSS_UP' END, CASE WHEN old >= 0 AND stk < 0 THEN 'EMA20_CROSS_DOWN' END,
 CASE WHEN stk > 0 AND low <= fast THEN 'PULLBACK_TOUCH_EMA20_LONG' END, CASE WHEN stk < 0 AND high >= fast THEN 'PULLBACK_TOUCH_EMA20_SHORT' END, CASE WHEN stk > 0 AND low <= slow THEN 'PULLBACK_TOUCH_EMA50_LONG' END, CASE WHEN stk < 0 AND high >= slow THEN 'PULLBACK_TOUCH_EMA50_SHORT' END,
 CASE WHEN atr > 0 AND abs(close - open) / (high - low) >= 0.7 AND (high - low) / atr BETWEEN 0.6 AND 2 THEN CASE WHEN close > open THEN 'STRONG_CANDLE_UP' ELSE 'STRONG_CANDLE_DOWN' END END]) AS event FROM d1) SELECT symbol, event, count(*) AS n FROM e WHERE event IS NOT NULL GROUP BY 1, 2""")
def bar_event_counts(spark, d):
    """Middles of bars and of bodies stand in for the two means here, so that SQL can say the same."""
    rows = series(spark, d).withColumns({"fast": (F.col("high") + F.col("low")) / 2, "slow": (F.col("open") + F.col("close")) / 2, "atr": (F.col("high") - F.col("low")) * 0.8})
    found = E.bar_events(rows, KEY).select("symbol", F.explode("events").alias("event"))
    return found.groupBy("symbol", "event").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_orderpriority AS symbol, o_orderkey AS ts, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderkey END AS entry_ts, o_totalprice AS entry, CASE WHEN o_orderkey % 4 <= 1 THEN o_orderkey END AS exit_ts, o_totalprice AS price FROM orders),
w AS (SELECT *, count(entry_ts) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS trade FROM g)
SELECT symbol, trade, max(entry_ts) AS entry_ts, max(CASE WHEN entry_ts IS NOT NULL THEN entry END) AS entry, CASE WHEN trade > 0 THEN min(exit_ts) END AS exit_ts, CASE WHEN trade > 0 THEN arg_min(price, exit_ts) END AS price, count(exit_ts) - CASE WHEN trade > 0 AND count(exit_ts) > 0 THEN 1 ELSE 0 END AS unmatched_exits FROM w GROUP BY 1, 2 HAVING count(entry_ts) + count(exit_ts) > 0""")
def whole_trades(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    log = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), key.alias("ts"), F.when((F.col("o_orderstatus") == "F") & (key % 3 == 0), key).alias("entry_ts"), price.alias("entry"), F.when(key % 4 <= 1, key).alias("exit_ts"), price.alias("price")
    )
    return E.whole_trades(log, KEY, ["ts"], ["entry_ts", "entry"], ["exit_ts", "price"])


@query("""WITH x AS (SELECT l_orderkey AS tag, l_linenumber = 1 AS s, round(l_extendedprice + l_tax, 2) - l_extendedprice AS slip, CASE WHEN l_quantity > 45 THEN 0.05 ELSE 0.0 END AS sl, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS tp, l_quantity > 40 AS part, l_tax, l_discount FROM lineitem), y AS (SELECT * FROM x WHERE s),
z AS (SELECT count(*) AS n FROM (SELECT tag FROM x GROUP BY 1 HAVING count(*) > 1 AND bool_or(s)))
SELECT count(*) AS submissions, count(CASE WHEN part THEN 1 END) AS partial_fills, count(CASE WHEN sl > 0.01 THEN 1 END) AS sl_mismatches, 0 AS tp_mismatches, count(slip) AS slippages, round(avg(slip), 6) AS slippage_mean, round(max(slip), 6) AS slippage_worst, round(sum(l_tax), 4) AS commission_total, round(sum(l_discount), 4) AS swap_total,
 (SELECT n FROM z) AS duplicate_tags, (SELECT n FROM z) = 0 AND count(CASE WHEN sl > 0.01 THEN 1 END) = 0 AS clean FROM y""")
def fill_summary(spark, d):
    quantity, tax, price = F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("client_tag"), F.when(F.col("l_linenumber") == 1, "SUBMIT").otherwise("MODIFY").alias("action"), price.alias("requested_price"), F.round(price + tax, 2).alias("filled_price"),
        F.lit(0.0).alias("requested_sl"), F.when(quantity > 45, 0.05).otherwise(0.0).alias("broker_sl"), tax.alias("requested_tp"), F.when(F.col("l_returnflag") != "N", tax).alias("broker_tp"),
        quantity.alias("requested_volume"), F.least(quantity, F.lit(40)).alias("filled_volume"), tax.alias("commission"), F.col("l_discount").alias("swap"),
    )
    found = E.fill_summary(rows)
    return found.withColumns({**r6("slippage_mean", "slippage_worst"), "commission_total": F.round("commission_total", 4), "swap_total": F.round("swap_total", 4)})


@query(f"""WITH {TRADES}, x AS (SELECT ts, trade_id, r FROM t WHERE direction <> 'F'), y AS (SELECT ts, trade_id, r * 1.1 AS r FROM t WHERE direction <> 'P'), j AS (SELECT coalesce(x.ts, y.ts) AS ts, x.r AS a, y.r AS b FROM x FULL JOIN y ON x.ts = y.ts AND x.trade_id = y.trade_id)
SELECT year(ts) AS year, count(CASE WHEN a IS NULL THEN 1 END) AS added, round(coalesce(sum(CASE WHEN a IS NULL THEN b END), 0), 4) AS added_r, count(CASE WHEN b IS NULL THEN 1 END) AS displaced, round(coalesce(sum(CASE WHEN b IS NULL THEN a END), 0), 4) AS displaced_r, round(coalesce(sum(b), 0) - coalesce(sum(a), 0), 4) AS net_r FROM j GROUP BY 1""")
def contribution_by_year(spark, d):
    rows = trades(spark, d)
    found = E.contribution(rows.filter("direction <> 'F'"), rows.filter("direction <> 'P'").withColumn("r", F.col("r") * 1.1), ["ts", "trade_id"], F.year("ts"), "year")
    return found.withColumns({n: F.round(n, 4) for n in ("added_r", "displaced_r", "net_r")})


@query(f"""WITH {TRADES}, w AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY trade_id) AS position, sum(CAST(round(pnl * 100) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY trade_id ROWS UNBOUNDED PRECEDING) AS s FROM t)
SELECT position, count(*) AS paths, round(quantile_cont(s, 0.05), 3) AS p5, round(quantile_cont(s, 0.5), 3) AS median, round(quantile_cont(s, 0.95), 3) AS p95 FROM w GROUP BY 1""")
def path_envelope(spark, d):
    """In whole cents."""
    rows = trades(spark, d).withColumn("cents", F.round(F.col("pnl") * 100).cast("long"))
    found = E.envelope(rows, "symbol", "trade_id", "cents", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return found.withColumns({n: F.round(n, 3) for n in ("p5", "median", "p95")})
