"""Contention for one slot, and resampled paths. Systems are made of orders: a series for each customer, the status as the
setup; the family is P. The system alone has no P, the system with the family lacks what cost 120,000 or less."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.operators import contention as C
from tidemill.operators import reconcile as O
from tidemill.operators import robustness as B
from tidemill.plans.queries import TRADES, query, table, ticks, trades
from tidemill.streaming.stateful import table_in_order

KEY, FAMILY = ["symbol"], "P"


def _systems(spark, d):
    """(baseline, combined, standalone, orders of combined)."""
    day = F.expr("interval 1 day")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("trade_id"), F.col("o_orderstatus").alias("setup"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_totalprice") > 150000, "LONG").otherwise("SHORT").alias("direction"), F.col("o_orderdate").cast("timestamp_ntz").alias("entry_ts"),
        ((F.col("o_totalprice") - 150000) / 70000).alias("r"),
    )
    rows = rows.withColumn("exit_ts", F.col("entry_ts") + F.make_dt_interval(days=F.floor(F.col("price") / 5000).cast("int")))
    kept = F.col("price") > 120000
    orders = rows.select(*KEY, "setup", (F.col("entry_ts") - day * 20).alias("created_ts"), F.when(kept, F.col("entry_ts")).alias("fill_ts"), (F.col("entry_ts") + day * 10).alias("expiry_ts"))
    return rows.filter(F.col("setup") != FAMILY), rows.filter(kept), rows.filter(F.col("setup") == FAMILY), orders


_SYSTEMS = """o AS (SELECT o_custkey AS symbol, o_orderkey AS trade_id, o_orderstatus AS setup, o_totalprice AS price, CASE WHEN o_totalprice > 150000 THEN 'LONG' ELSE 'SHORT' END AS direction,
  o_orderdate::TIMESTAMP AS entry_ts, o_orderdate::TIMESTAMP + to_days(floor(o_totalprice / 5000)::INT) AS exit_ts, (o_totalprice - 150000) / 70000 AS r FROM orders),
base AS (SELECT * FROM o WHERE setup <> 'P'), comb AS (SELECT * FROM o WHERE price > 120000), alone AS (SELECT * FROM o WHERE setup = 'P'),
waits AS (SELECT symbol, setup, entry_ts - interval '20 days' AS a, CASE WHEN price > 120000 THEN entry_ts ELSE entry_ts + interval '10 days' END AS z FROM o WHERE setup <> 'P'),
g0 AS (SELECT * FROM base b WHERE NOT EXISTS (FROM comb c WHERE c.symbol = b.symbol AND c.setup = b.setup AND c.direction = b.direction AND c.entry_ts = b.entry_ts)),
g1 AS (SELECT g.*, c.entry_ts AS held_from, c.setup AS held_by FROM g0 g LEFT JOIN comb c ON c.symbol = g.symbol AND g.entry_ts BETWEEN c.entry_ts AND c.exit_ts
  QUALIFY row_number() OVER (PARTITION BY g.trade_id ORDER BY c.entry_ts, c.exit_ts, c.trade_id) = 1),
gone AS (SELECT *, CASE WHEN held_by = 'P' AND held_from = entry_ts THEN 'DISPLACED_SAME_BAR' WHEN held_by = 'P' THEN 'BLOCKED_WHILE_HOLDING' ELSE 'LOST_OTHERWISE' END AS class FROM g1),
fam AS (SELECT f.*, EXISTS (FROM base b WHERE b.symbol = f.symbol AND f.entry_ts BETWEEN b.entry_ts AND b.exit_ts) AS clash, EXISTS (FROM base b WHERE b.symbol = f.symbol AND f.entry_ts = b.entry_ts) AS same,
  EXISTS (FROM gone g WHERE g.class <> 'LOST_OTHERWISE' AND g.symbol = f.symbol AND g.entry_ts > f.entry_ts AND g.entry_ts <= f.exit_ts) AS later,
  EXISTS (FROM base b WHERE b.symbol = f.symbol AND b.entry_ts <= f.exit_ts AND b.exit_ts >= f.entry_ts) AS "overlaps" FROM comb f WHERE setup = 'P'),
family AS (SELECT *, CASE WHEN clash AND same THEN 'DISPLACED_A_TRADE' WHEN later THEN 'BLOCKED_A_TRADE' WHEN clash THEN 'DISPLACED_A_TRADE' ELSE 'ADDITIVE' END AS class FROM fam),
s1 AS (SELECT a.*, c.setup AS held_by FROM alone a LEFT JOIN comb c ON c.symbol = a.symbol AND a.entry_ts BETWEEN c.entry_ts AND c.exit_ts QUALIFY row_number() OVER (PARTITION BY a.trade_id ORDER BY c.entry_ts, c.exit_ts, c.trade_id) = 1),
suppressed AS (SELECT *, CASE WHEN EXISTS (FROM comb c WHERE c.setup = 'P' AND c.symbol = s1.symbol AND c.entry_ts = s1.entry_ts) THEN 'REACHED' WHEN held_by <> 'P' THEN 'HELD_POSITION'
  WHEN EXISTS (FROM waits w WHERE w.symbol = s1.symbol AND s1.entry_ts BETWEEN w.a AND w.z) THEN 'HELD_ORDER' ELSE 'HELD_POSITION' END AS class FROM s1)"""


@query(f"""WITH {_SYSTEMS}, u AS (SELECT 'LOST' AS part, class, setup, r FROM gone UNION ALL SELECT 'FAMILY', class, setup, r FROM family UNION ALL SELECT 'SUPPRESSED', class, setup, r FROM suppressed)
SELECT part, class, setup, count(*) AS trades, round(sum(r), 5) AS total_r, round(avg(r), 6) AS mean_r FROM u GROUP BY 1, 2, 3""")
def contention_ledger(spark, d):
    found = C.ledger(*_systems(spark, d), KEY, FAMILY)
    return found.withColumns({"total_r": F.round("total_r", 5), "mean_r": F.round("mean_r", 6)})


@query(f"""WITH {_SYSTEMS} SELECT trade_id, class, "overlaps" FROM family""")
def contention_family(spark, d):
    baseline, combined, _, _ = _systems(spark, d)
    return C.family_trades(baseline, combined, C.lost(baseline, combined, KEY, FAMILY), KEY, FAMILY).select("trade_id", "class", "overlaps")


@query(f"""WITH {_SYSTEMS}, f AS (SELECT coalesce(sum(r) FILTER (class = 'ADDITIVE'), 0) AS free_r, count(*) FILTER (class = 'ADDITIVE') AS free_trades, count(*) AS family_trades FROM family),
c AS (SELECT coalesce(sum(r), 0) AS cost_r FROM gone WHERE class <> 'LOST_OTHERWISE')
SELECT round(free_r, 5) AS free_r, round(cost_r, 5) AS cost_r, free_trades, family_trades, round(free_r - cost_r, 5) AS net_free_r, round(100.0 * (family_trades - free_trades) / family_trades, 6) AS costly_percent FROM f, c""")
def contention_contribution(spark, d):
    found = C.contribution(C.ledger(*_systems(spark, d), KEY, FAMILY))
    return found.withColumns({**{n: F.round(n, 5) for n in ("free_r", "cost_r", "net_free_r")}, "costly_percent": F.round("costly_percent", 6)})


@query(f"""WITH {_SYSTEMS}, m AS (SELECT date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 AS m FROM orders), n AS (
SELECT (SELECT count(*) FROM o) AS events, (SELECT count(*) FROM o WHERE setup = 'P' OR price > 200000) AS setups, (SELECT count(*) FROM alone) AS fills, (SELECT count(*) FROM family) AS added, (SELECT count(*) FROM family WHERE class = 'ADDITIVE') AS free)
SELECT events, setups, fills, added, free, round(events / m, 2) AS events_per_month, round(setups / m, 2) AS setups_per_month, round(fills / m, 2) AS fills_per_month, round(added / m, 2) AS added_per_month, round(free / m, 2) AS free_per_month,
 round(100.0 * setups / events, 2) AS events_to_setups_percent, round(100.0 * fills / setups, 2) AS setups_to_fills_percent, round(100.0 * free / fills, 2) AS fills_to_free_percent FROM n, m""")
def capacity_funnel(spark, d):
    baseline, combined, alone, _ = _systems(spark, d)
    every = table(spark, d, "orders")
    family = C.family_trades(baseline, combined, C.lost(baseline, combined, KEY, FAMILY), KEY, FAMILY)
    first, last = every.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    months = F.lit((last.year - first.year) * 12 + last.month - first.month + 1)
    setups = every.filter("o_orderstatus = 'P' or o_totalprice > 200000")
    return C.capacity(every, setups, alone, family, family.filter("class = 'ADDITIVE'"), months)


# --- resampled paths

SIMULATIONS, LENGTH = 100, 4  # results are in 70,000ths: their sums are no short decimals, which two engines round apart


def _results(spark, d):
    rows = trades(spark, d).withColumn("r", (F.col("price") - 150000) / 70000)
    return B.results_of_trades(rows, exit_ts="ts", entry_ts="ts")


def _paths_sql(length: int, name: str = "paths") -> str:
    return f"""{name}_k AS (SELECT sim, place, ('0x' || substr(md5('42:' || sim || ':' || place), 1, 13))::BIGINT % ((SELECT count(*) FROM r) - {length} + 1) AS start
  FROM range({SIMULATIONS}) a(sim), range((SELECT (count(*) + {length} - 1) // {length} FROM r)) b(place)),
{name}_s AS (SELECT sim, place * {length} + i AS step, r.r FROM {name}_k k, range({length}) x(i) JOIN r ON r.n = k.start + i WHERE place * {length} + i < (SELECT count(*) FROM r)),
{name}_c AS (SELECT *, sum(r) OVER w AS cum, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER w AS gl, sum(CASE WHEN r > 0 THEN 0 ELSE 1 END) OVER w AS gw, sum(ln(greatest(1 + 0.01 * r, 1e-300))) OVER w AS eq FROM {name}_s WINDOW w AS (PARTITION BY sim ORDER BY step)),
{name}_d AS (SELECT *, max(cum) OVER (PARTITION BY sim ORDER BY step) - cum AS dd, sum((r < 0)::INT) OVER (PARTITION BY sim, gl) AS ls, sum((r > 0)::INT) OVER (PARTITION BY sim, gw) AS ws FROM {name}_c),
{name} AS (SELECT sim, last(cum ORDER BY step) AS terminal_r, max(dd) AS max_drawdown_r, max(ls)::BIGINT AS losing_streak, max(ws)::BIGINT AS winning_streak, min(eq) <= ln(0.5) AS ruined FROM {name}_d GROUP BY 1)"""


_R = f"WITH {TRADES}, r AS (SELECT row_number() OVER (ORDER BY ts, trade_id) - 1 AS n, (price - 150000) / 70000 AS r FROM t)"
_SHARES = ", ".join(f"round(quantile_cont(value, {q}), 5) AS {n}" for n, q in (("p5", 0.05), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


def _stacked(name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM {name}" for m in B.METRICS)


@query(f"{_R}, {_paths_sql(LENGTH)} SELECT sim, round(terminal_r, 7) AS terminal_r, round(max_drawdown_r, 7) AS max_drawdown_r, losing_streak, winning_streak, ruined FROM paths")
def bootstrap_paths(spark, d):
    found = B.paths(_results(spark, d), B.BLOCK, SIMULATIONS, block=LENGTH, ruin_level=0.5)
    return found.withColumns({n: F.round(n, 7) for n in ("terminal_r", "max_drawdown_r")})


@query(f"""{_R}, {_paths_sql(LENGTH)}, {_paths_sql(1, "single")}, u AS (SELECT 'BLOCK_BOOTSTRAP' AS method, * FROM ({_stacked("paths")}) UNION ALL SELECT 'IID_BOOTSTRAP', * FROM ({_stacked("single")}))
SELECT method, metric, {_SHARES}, round(min(value), 5) AS minimum, round(max(value), 5) AS maximum, round(avg(value), 5) AS mean FROM u GROUP BY 1, 2""")
def iid_against_block(spark, d):
    own = _results(spark, d)
    found = B.iid_against_block(B.paths(own, B.IID, SIMULATIONS), B.paths(own, B.BLOCK, SIMULATIONS, block=LENGTH))
    return found.select("method", "metric", *[F.round(c, 5).alias(c) for c in found.columns if c not in ("method", "metric")])


_SEEN = """obs_c AS (SELECT n, r, sum(r) OVER (ORDER BY n) AS cum FROM r), obs AS (SELECT max(dd) AS observed FROM (SELECT max(cum) OVER (ORDER BY n) - cum AS dd FROM obs_c))"""


@query(f"""{_R}, {_paths_sql(LENGTH)}, {_SEEN}, w AS (SELECT max_drawdown_r AS v, row_number() OVER (ORDER BY max_drawdown_r DESC) AS k FROM paths)
SELECT round(any_value(observed), 5) AS observed, round(avg((max_drawdown_r <= observed)::INT) * 100, 5) AS observed_percentile, round(avg((max_drawdown_r >= 100)::INT), 5) AS breach_probability,
 round(quantile_cont(max_drawdown_r, 0.5), 5) AS median, round(quantile_cont(max_drawdown_r, 0.9), 5) AS p90, round(quantile_cont(max_drawdown_r, 0.95), 5) AS p95, round(quantile_cont(max_drawdown_r, 0.99), 5) AS p99,
 (SELECT round(avg(v), 5) FROM w WHERE k <= ceil({SIMULATIONS} * 0.05)) AS worst_5_percent_mean FROM paths, obs""")
def drawdown_risk(spark, d):
    own = _results(spark, d)
    found = B.drawdown_risk(B.paths(own, B.BLOCK, SIMULATIONS, block=LENGTH), B.observed(own), 100.0)
    return found.select(*[F.round(c, 5).alias(c) for c in found.columns])


@query(f"""{_R}, p AS (SELECT sim, r, row_number() OVER (PARTITION BY sim ORDER BY ('0x' || substr(md5('42:' || sim || ':' || n), 1, 13))::BIGINT, n) AS step FROM r, range({SIMULATIONS}) a(sim)),
c AS (SELECT *, sum(r) OVER w AS cum, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER w AS gl FROM p WINDOW w AS (PARTITION BY sim ORDER BY step)),
e AS (SELECT *, max(cum) OVER (PARTITION BY sim ORDER BY step) - cum AS dd, sum((r < 0)::INT) OVER (PARTITION BY sim, gl) AS ls FROM c), m AS (SELECT sim, max(dd) AS dd, max(ls) AS ls FROM e GROUP BY 1),
{_SEEN}, og AS (SELECT r, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER (ORDER BY n) AS g FROM r), os AS (SELECT max(x) AS observed FROM (SELECT sum((r < 0)::INT) AS x FROM og GROUP BY g)),
u AS (SELECT 'max_drawdown_r' AS metric, observed::DOUBLE AS observed, avg((dd <= observed + 1e-9)::INT) * 100 AS percentile FROM m, obs GROUP BY observed UNION ALL SELECT 'losing_streak', observed::DOUBLE, avg((ls <= observed)::INT) * 100 FROM m, os GROUP BY observed)
SELECT metric, round(observed, 5) AS observed, round(percentile, 5) AS percentile, CASE WHEN metric = 'max_drawdown_r' AND percentile >= 95 THEN 'UNUSUALLY SEVERE CLUSTERING' WHEN metric = 'max_drawdown_r' AND percentile <= 5 THEN 'LOWER THAN TYPICAL DRAWDOWN' END AS warning FROM u""")
def sequence_dependency(spark, d):
    own = _results(spark, d)
    found = B.sequence_dependency(B.paths(own, B.PERMUTATION, SIMULATIONS), B.observed(own))
    return found.withColumns({n: F.round(n, 5) for n in ("observed", "percentile")})


# --- two runs' orders, and rows out of order


def _two_runs(spark, d):
    """(original, synthetic, bars): orders by customer. Dear ones are missing in the original, cheap ones in the synthetic run; from
    some prices on they expire, fill later, or fill at another price there."""
    day, price = F.expr("interval 1 day"), F.col("o_totalprice")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("signal_ts"), F.when(price > 150000, "LONG").otherwise("SHORT").alias("direction"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("setup"), "o_orderkey", price.alias("price"), F.col("o_orderstatus").alias("state"),
    )
    rows = rows.groupBy(*KEY, "signal_ts", "direction", "setup").agg(F.min(F.struct("o_orderkey", "price", "state")).alias("_r")).select(*KEY, "signal_ts", "direction", "setup", "_r.price", "_r.state")
    status = F.when(F.col("state") == "F", "triggered").when(F.col("state") == "O", "expired").otherwise("cancelled")
    trigger = F.col("price") - F.when(F.col("price") < 170000, 1).otherwise(0)

    def run(state: Column, late: Column, more: Column):
        filled = state == "triggered"
        return [
            *KEY, "signal_ts", "direction", "setup", state.alias("status"), F.when(filled, F.col("signal_ts") + late).alias("fill_ts"), F.when(filled, F.col("price") + more).alias("fill_price"),
            F.when(state == "cancelled", "by its maker").alias("cancel_reason"), F.col("signal_ts").alias("created_ts"), trigger.alias("trigger"), (F.col("price") - 5).alias("stop"),
        ]

    original = rows.filter("price < 220000").select(*run(status, day, F.lit(0)))
    moved = F.when(F.col("price") > 200000, "expired").when((F.col("price") < 90000) & (status == "expired"), "triggered").otherwise(status)
    synthetic = rows.filter("price > 60000").select(*run(moved, F.when(F.col("price") > 180000, day * 2).otherwise(day), F.when(F.col("price") > 160000, 1).otherwise(0)))
    bars = rows.withColumn("ts", F.explode(F.array(F.col("signal_ts") + day, F.col("signal_ts") + day * 2))).groupBy(*KEY, "ts").agg(F.max("price").alias("p"))
    return original, synthetic, bars.select(*KEY, "ts", (F.col("p") - 1).alias("open"), (F.col("p") - 0.2).alias("high"), (F.col("p") - 3).alias("low"), (F.col("p") - 2).alias("close"))


@query("""WITH x AS (SELECT o_custkey AS symbol, o_orderdate::TIMESTAMP AS signal_ts, CASE WHEN o_totalprice > 150000 THEN 'LONG' ELSE 'SHORT' END AS direction, nullif(o_orderpriority, '5-LOW') AS setup, o_orderkey, o_totalprice AS price, o_orderstatus AS state FROM orders),
r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, signal_ts, direction, setup ORDER BY o_orderkey) = 1),
s AS (SELECT *, CASE state WHEN 'F' THEN 'triggered' WHEN 'O' THEN 'expired' ELSE 'cancelled' END AS st, price - CASE WHEN price < 170000 THEN 1 ELSE 0 END AS trigger FROM r),
t AS (SELECT *, CASE WHEN price < 220000 THEN st END AS a, CASE WHEN price > 60000 THEN CASE WHEN price > 200000 THEN 'expired' WHEN price < 90000 AND st = 'expired' THEN 'triggered' ELSE st END END AS b FROM s),
c AS (SELECT *, CASE WHEN b = 'triggered' AND coalesce(a, '') <> 'triggered' THEN 'SYNTHETIC_ONLY_FILL' WHEN a = 'triggered' AND coalesce(b, '') <> 'triggered' THEN 'ORIGINAL_ONLY_FILL'
  WHEN a = 'triggered' THEN CASE WHEN price > 180000 THEN 'TIMING_CHANGED_FILL' WHEN price > 160000 THEN 'PRICE_CHANGED_FILL' ELSE 'SAME_FILL' END WHEN a = b AND a = 'expired' THEN 'EXPIRED_BOTH' WHEN a = b AND a = 'cancelled' THEN 'CANCELED_BOTH' ELSE 'OTHER_ORDER_STATE' END AS class FROM t),
k AS (SELECT *, CASE WHEN class LIKE '%ONLY_FILL' THEN signal_ts + CASE WHEN class LIKE 'S%' AND price > 180000 THEN interval '2 days' ELSE interval '1 day' END END AS audit_ts,
  max(CASE WHEN class NOT IN ('SAME_FILL', 'EXPIRED_BOTH', 'CANCELED_BOTH') THEN strftime(signal_ts, '%Y-%m-%d') || '|' || direction || '|' || coalesce(setup, ' ') || '|' || class END) OVER (PARTITION BY symbol ORDER BY signal_ts, direction, setup NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c),
p AS (SELECT symbol, signal_ts + unnest([interval '1 day', interval '2 days']) AS ts, price FROM r), g AS (SELECT symbol, ts, max(price) AS p FROM p GROUP BY 1, 2)
SELECT k.symbol, signal_ts, direction, setup, class, audit_ts, CASE WHEN audit_ts IS NOT NULL THEN CASE WHEN class LIKE 'S%' AND direction = 'LONG' AND p - 0.2 < trigger AND trigger <= p - 0.2 + 0.5 THEN 'LONG_ASK_TRIGGER'
  WHEN class LIKE 'S%' AND direction = 'LONG' AND p - 1 + 0.5 >= trigger THEN 'GAP_EFFECT' WHEN direction = 'SHORT' AND a IS NOT NULL AND b IS NOT NULL THEN 'SHORT_BID_TRIGGER' ELSE 'OTHER' END WHEN class = 'OTHER_ORDER_STATE' THEN 'STATE_DIVERGENCE' END AS reason,
  string_split(prior, '|')[1]::TIMESTAMP AS prior_ts, string_split(prior, '|')[4] AS prior_class FROM k LEFT JOIN g ON g.symbol = k.symbol AND g.ts = k.audit_ts""")
def order_reconciliation(spark, d):
    found = O.reconciled(*_two_runs(spark, d), KEY, 0.5)
    return found.select(*KEY, "signal_ts", "direction", "setup", "class", "audit_ts", "reason", "prior_ts", "prior_class")


@query("""WITH e AS (SELECT event_type AS symbol, ts, event_id, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)
SELECT symbol, ts, event_id, CASE WHEN ts < last THEN 'LATE' ELSE 'ACCEPTED' END AS status, CASE WHEN ts < last THEN round(epoch(last) - epoch(ts), 6) ELSE 0 END AS behind FROM e""")
def late_rows(spark, d):
    """Events as they arrive (by id): those whose time is before that of an earlier one of their series."""
    found = table_in_order(ticks(spark, d), KEY, seq="event_id")
    return found.select("symbol", "ts", "event_id", "status", F.round("behind", 6).alias("behind"))
