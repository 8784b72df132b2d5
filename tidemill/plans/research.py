"""Queries of research aggregates, contract arithmetic and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import broker as K
from tidemill.operators import carry
from tidemill.operators import research as Z
from tidemill.plans.queries import KEY, TRADES, query, r6, table, ticks, trades

SIZE = "CASE WHEN price < 100000 THEN 'small' WHEN price < 200000 THEN 'middle' ELSE 'large' END"
LOG = "log AS (SELECT o_orderpriority AS symbol, o_orderkey AS ts, CASE o_orderstatus WHEN 'O' THEN 'CREATED' WHEN 'F' THEN 'FILLED' ELSE 'EXPIRED' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS entry_ts, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 20000 THEN o_orderkey + 1 END AS exit_ts, CASE WHEN o_totalprice > 150000 THEN 'Take profit' ELSE 'Stop loss' END AS exit_reason, (o_totalprice - 100000) / 50000 AS mfe_r FROM orders)"
CONTRACT = K.Contract(0.01, 1.0, 0.01, 0.01, 50.0, 0.01, 100)


def sized(spark, d):
    size = F.when(F.col("price") < 100000, "small").when(F.col("price") < 200000, "middle").otherwise("large")
    return trades(spark, d).withColumns({"year": F.year("ts"), "size": size})


def log(spark, d):
    """Orders as a log of bars."""
    filled, price = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("ts"), F.when(F.col("o_orderstatus") == "O", "CREATED").when(filled, "FILLED").otherwise("EXPIRED").alias("status"),
        F.when(filled, F.col("o_orderkey")).alias("entry_ts"), F.when(filled & (price > 20000), F.col("o_orderkey") + 1).alias("exit_ts"),
        F.when(price > 150000, "Take profit").otherwise("Stop loss").alias("exit_reason"), ((price - 100000) / 50000).alias("mfe_r"),
    )


@query(f"""WITH {TRADES}, x AS (SELECT 'size' AS feature, {SIZE} AS bucket, symbol, year(ts) AS y, r FROM t UNION ALL SELECT 'status', direction, symbol, year(ts), r FROM t), c AS (SELECT feature, bucket, symbol, y, sum(r) AS s, count(*) AS n FROM x GROUP BY ALL)
SELECT feature, bucket, count(CASE WHEN s > 0 THEN 1 END) AS positive_cells, count(*) AS cells, min(n) AS fewest, CAST(sum(n) AS BIGINT) AS trades, round(sum(s) / sum(n), 6) AS mean FROM c GROUP BY 1, 2""")
def consistency_screen(spark, d):
    return Z.consistency_screen(sized(spark, d), {"size": F.col("size"), "status": F.col("direction")}, ["symbol", "year"]).withColumns(r6("mean"))


@query(f"""WITH {TRADES}, m AS (SELECT year(ts) AS y, sign(quantile_cont(CASE WHEN pnl > 1e-9 THEN price END, 0.5) - quantile_cont(CASE WHEN pnl < -1e-9 THEN price END, 0.5)) AS s FROM t GROUP BY 1)
SELECT 'price' AS feature, count(*) AS periods, coalesce(count(s) = count(*) AND min(s) = max(s) AND min(s) <> 0, false) AS consistent FROM m""")
def separation_stability(spark, d):
    return Z.separation_stability(sized(spark, d), ["price"], "year")


@query(f"""WITH {TRADES}, x AS (SELECT 'direction' AS dimension, direction AS key, r FROM t UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), r FROM t UNION ALL SELECT 'size', {SIZE}, r FROM t) SELECT dimension, key, round(sum(r), 4) AS total, round(avg(r), 6) AS mean, count(*) AS n FROM x GROUP BY 1, 2""")
def loss_attribution(spark, d):
    found = Z.loss_attribution(sized(spark, d), {"direction": F.col("direction"), "month": F.date_format("ts", "yyyy-MM"), "size": F.col("size")})
    return found.withColumns({"total": F.round("total", 4), **r6("mean")})


@query(f"""WITH {TRADES}, l AS (SELECT year(ts) AS y, price / 50000 AS m FROM t WHERE pnl < -1e-9) SELECT CASE WHEN grouping(y) = 1 THEN 'all' ELSE CAST(y AS VARCHAR) END AS year, count(*) AS losers, count(CASE WHEN m <= 1 THEN 1 END) AS low, count(CASE WHEN m > 1 AND m <= 2 THEN 1 END) AS middle, count(CASE WHEN m > 2 THEN 1 END) AS far,
 round(count(CASE WHEN m <= 1 THEN 1 END) / count(*), 4) AS low_share, round(count(CASE WHEN m > 1 AND m <= 2 THEN 1 END) / count(*), 4) AS middle_share, round(count(CASE WHEN m > 2 THEN 1 END) / count(*), 4) AS far_share FROM l GROUP BY ROLLUP (y)""")
def failure_profile(spark, d):
    limits = {"low": (float("-inf"), 1.0), "middle": (1.0, 2.0), "far": (2.0, float("inf"))}
    return Z.failure_profile(sized(spark, d).withColumn("mfe_r", F.col("price") / 50000), limits, "year")


@query(f"""WITH {TRADES}, o AS (SELECT *, CASE WHEN pnl > 50000 THEN 'WIN' WHEN pnl < -50000 THEN 'LOSS' END AS outcome FROM t) SELECT CASE WHEN grouping(symbol) = 1 THEN 'All' ELSE symbol END AS symbol, CASE WHEN grouping(direction) = 1 THEN 'All' ELSE direction END AS direction, count(*) AS n, count(CASE WHEN outcome = 'WIN' THEN 1 END) AS wins, count(CASE WHEN outcome = 'LOSS' THEN 1 END) AS losses,
 round(avg(r), 6) AS expectancy, round(count(CASE WHEN outcome = 'WIN' THEN 1 END) / nullif(count(outcome), 0), 6) AS win_rate FROM o GROUP BY CUBE (symbol, direction)""")
def outcome_cells(spark, d):
    outcome = F.when(F.col("pnl") > 50000, "WIN").when(F.col("pnl") < -50000, "LOSS")
    return Z.outcome_cells(trades(spark, d).withColumn("outcome", outcome), ["symbol", "direction"]).withColumns(r6("expectancy", "win_rate"))


@query(f"""WITH {LOG} SELECT count(*) AS bars, count(CASE WHEN status = 'CREATED' THEN 1 END) AS created, count(CASE WHEN status = 'FILLED' THEN 1 END) AS filled, count(CASE WHEN status = 'EXPIRED' THEN 1 END) AS expired, count(CASE WHEN status = 'CANCELLED' THEN 1 END) AS cancelled, count(exit_ts) AS exits, count(CASE WHEN exit_reason LIKE 'Stop loss%' THEN 1 END) AS stop_exits, count(CASE WHEN exit_reason LIKE 'Take profit%' THEN 1 END) AS target_exits FROM log""")
def lifecycle_counts(spark, d):
    return Z.lifecycle_counts(log(spark, d))


@query(f"""WITH {LOG} SELECT symbol, max(ts) AS last_ts, CASE WHEN arg_max(status, ts) IN ('CREATED', 'ACTIVE') THEN arg_max(status, ts) END AS pending, CASE WHEN count(entry_ts) > count(exit_ts) THEN max(entry_ts) END AS open_since FROM log GROUP BY 1""")
def open_state(spark, d):
    return Z.open_state(log(spark, d), KEY)


@query(f"""WITH {TRADES}, f AS (SELECT symbol, strftime(ts, '%Y-%m') AS m, CASE WHEN count(*) >= 5 THEN 'SELECTED' ELSE 'NONE' END AS status, sum(pnl) AS pnl, avg(r) AS average_r, max(r) AS profit_factor, -min(r) AS drawdown FROM t GROUP BY 1, 2), s AS (SELECT * FROM f WHERE status = 'SELECTED')
SELECT round(count(CASE WHEN pnl > 0 THEN 1 END) * 100.0 / count(*), 6) AS profitable_percent, round(count(CASE WHEN average_r > 0 THEN 1 END) * 100.0 / count(*), 6) AS positive_r_percent, round(quantile_cont(profit_factor, 0.5), 6) AS median_profit_factor, round(quantile_cont(average_r, 0.5), 6) AS median_r, round(quantile_cont(drawdown, 0.5), 6) AS median_drawdown,
 round(min(average_r), 6) AS worst_r, round(max(drawdown), 6) AS worst_drawdown, round(count(*) * 100.0 / (SELECT count(*) FROM f), 6) AS coverage_percent FROM s""")
def fold_summary(spark, d):
    folds = trades(spark, d).groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("m")).agg(
        F.when(F.count("*") >= 5, "SELECTED").otherwise("NONE").alias("status"), F.sum("pnl").alias("pnl"), F.avg("r").alias("average_r"), F.max("r").alias("profit_factor"), (-F.min("r")).alias("drawdown")
    )
    found = Z.fold_summary(folds)
    return found.withColumns(r6(*found.columns))


@query("""WITH a AS (SELECT year(o_orderdate) AS year, CASE WHEN o_orderpriority LIKE '5%' THEN 'signal' ELSE 'order' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'triggered' ELSE 'expired' END AS status FROM orders)
SELECT CAST(year AS INTEGER) AS year, count(CASE WHEN kind = 'signal' THEN 1 END) AS signals, count(CASE WHEN kind = 'order' THEN 1 END) AS orders, count(CASE WHEN kind = 'order' AND status = 'triggered' THEN 1 END) AS fills, round(coalesce(count(CASE WHEN kind = 'order' AND status = 'triggered' THEN 1 END) * 100.0 / nullif(count(CASE WHEN kind = 'order' THEN 1 END), 0), 0), 6) AS fill_rate FROM a GROUP BY 1""")
def activity_by_year(spark, d):
    kind = F.when(F.col("o_orderpriority").startswith("5"), "signal").otherwise("order")
    rows = table(spark, d, "orders").select("o_orderdate", kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", "triggered").otherwise("expired").alias("status"))
    return Z.activity_by_period(rows, F.year("o_orderdate"), "year").withColumns(r6("fill_rate"))


@query(f"""WITH {TRADES}, x AS (SELECT 'low' AS gate, direction, strftime(ts, '%Y-%m') AS month, price < 100000 AS ok FROM t UNION ALL SELECT 'urgent', direction, strftime(ts, '%Y-%m'), symbol LIKE '1%' FROM t) SELECT gate, month, direction, count(CASE WHEN ok THEN 1 END) AS allowed, count(CASE WHEN NOT ok THEN 1 END) AS blocked FROM x GROUP BY 1, 2, 3""")
def gate_participation(spark, d):
    rows = trades(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return Z.participation(rows, {"low": F.col("price") < 100000, "urgent": F.col("symbol").startswith("1")}, ["month", "direction"])


@query(f"""WITH {TRADES}, v AS (SELECT symbol, CAST(floor(price / 20000) AS BIGINT) * 10 AS place, avg(r) AS mean, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT *, mean > 0.1 AND n > 5 AS improves FROM v)
SELECT a.symbol, a.place, round(a.mean, 6) AS mean, a.n, a.improves, coalesce(bool_or(b.improves), false) AS neighbour_improves, a.improves AND NOT coalesce(bool_or(b.improves), false) AS possible_overfit FROM w a LEFT JOIN w b ON a.symbol = b.symbol AND abs(a.place - b.place) = 10 GROUP BY a.symbol, a.place, a.mean, a.n, a.improves""")
def neighbour_stability(spark, d):
    variants = trades(spark, d).groupBy("symbol", (F.floor(F.col("price") / 20000) * 10).alias("place")).agg(F.avg("r").alias("mean"), F.count("*").alias("n"))
    return Z.neighbour_stability(variants, KEY, "place", {"mean": 0.1, "n": 5}, 10).withColumns(r6("mean"))


@query(f"""WITH {LOG} SELECT count(*) AS trades, round(avg(mfe_r), 6) AS average_mfe_r, round(avg(CASE WHEN mfe_r >= 0.5 THEN 100.0 ELSE 0.0 END), 6) AS reached_0_5r_percent, round(avg(CASE WHEN mfe_r >= 1 THEN 100.0 ELSE 0.0 END), 6) AS reached_1r_percent FROM log WHERE exit_reason LIKE 'Stop loss%'""")
def stopped_summary(spark, d):
    found = Z.stopped_summary(log(spark, d), (0.5, 1.0))
    return found.withColumns(r6("average_mfe_r", "reached_0_5r_percent", "reached_1r_percent"))


@query(f"""WITH {TRADES} SELECT direction, symbol, count(r) AS variants, round(avg(r), 6) AS mean, round(max(r), 6) AS best FROM t GROUP BY 1, 2""")
def parameter_surface(spark, d):
    return Z.surface(trades(spark, d), "direction", "r", "symbol").withColumns(r6("mean", "best"))


@query("""WITH y AS (SELECT l_orderkey AS k, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS price FROM lineitem GROUP BY 1) SELECT count(*) AS overlap, count(CASE WHEN abs(o_totalprice - price) <= 1000 THEN 1 END) AS agree, count(CASE WHEN abs(o_totalprice - price) > 1000 THEN 1 END) AS differ FROM orders JOIN y ON o_orderkey = k""")
def overlap_check(spark, d):
    price = F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("price")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return Z.overlap_check(orders, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(price), ["k"], ["price"], 1000)


@query("""SELECT event_type AS symbol, time_bucket(interval '15 minutes', ts) AS ts, min(value) AS raw FROM events GROUP BY event_type, time_bucket(interval '15 minutes', ts)""")
def bucket_minimum(spark, d):
    return Z.bucket_minimum(ticks(spark, d), KEY, "raw", 900)


@query("""SELECT n_nationkey, n_name FROM nation WHERE contains(lower(CAST(n_nationkey AS VARCHAR)), 'an') OR contains(lower(n_name), 'an')""")
def row_search(spark, d):
    return Z.row_search(table(spark, d, "nation").select("n_nationkey", "n_name"), "AN")


@query(f"""WITH {TRADES}, p AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, sum(pnl) AS net FROM t GROUP BY 1, 2) SELECT symbol, month, round(10000000 + coalesce(sum(net) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS opening FROM p""")
def opening_equity(spark, d):
    return Z.equity_before(trades(spark, d), KEY, F.date_format("ts", "yyyy-MM"), "month", 1e7).withColumn("opening", F.round("opening", 2))


@query(f"""WITH {TRADES} SELECT direction, count(price) AS n, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.5), 6) AS median, round(quantile_cont(price, 0.99), 6) AS p99 FROM t GROUP BY 1""")
def exact_percentiles(spark, d):
    return carry.percentiles(trades(spark, d), ["direction"], F.col("price"), {"p25": 0.25, "median": 0.5, "p99": 0.99}).withColumns(r6("p25", "median", "p99"))


@query("""WITH p AS (SELECT event_id, value + 100 AS entry, value + 100 - (user_id % 5) AS stop FROM events), q AS (SELECT *, CASE WHEN entry - stop >= 1 AND stop < entry THEN (entry - stop + 0.5) / 0.01 END AS lost FROM p), z AS (SELECT *, least(floor(CAST(10000 * 2.0 / 100 / lost AS DECIMAL(28, 8)) * 100) / 100, 50) AS lots FROM q)
SELECT event_id, CASE WHEN entry - stop < 1 THEN 'too near' END AS fault, round(lost, 4) AS lost, CASE WHEN lots >= 0.01 THEN CAST(lots AS DOUBLE) END AS lots FROM z""")
def contract_size(spark, d):
    entry = F.col("price")
    stop, long, spread = entry - F.col("user_id") % 5, F.lit("LONG"), F.lit(0.5)
    near = F.when(entry - stop < 1, "too near")
    lots = K.lot_size(F.lit(10000.0), 2.0, entry, stop, long, CONTRACT, spread)
    return ticks(spark, d).select("event_id", near.alias("fault"), F.round(K.loss_per_lot(entry, stop, long, CONTRACT, spread), 4).alias("lost"), lots.alias("lots"))


@query()
def signal_match(spark, d):
    rows = ticks(spark, d).select(F.date_trunc("minute", "ts").alias("ts"), F.when(F.col("user_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.col("event_id").alias("id"), "symbol")
    return Z.signal_match(*(rows.filter(F.col("symbol") == s).drop("symbol") for s in ("click", "view")), 900)
