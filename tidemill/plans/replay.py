"""Replays of ambiguous bars. Trades enter at the open of each day's bar of a series, with stop and target a quarter of its
range away; pending orders have their trigger half as far. Quotes are the events themselves, with a spread that varies, and
hours as the lower time frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import execution_replay as E
from tidemill.plans.queries import KEY, bars, bars_sql, query, ticks

DAY = 86_400


def _days(spark, d):
    rows = bars(spark, d, DAY).filter("high > low")
    long = F.col("close") >= F.col("open")
    sign, half = F.when(long, 1).otherwise(-1), (F.col("high") - F.col("low")) / 4
    rows = rows.withColumns({"direction": F.when(long, "LONG").otherwise("SHORT"), "sign": sign, "half": half, "signal_ts": F.col("ts") - F.expr("interval 1 day")})
    rows = rows.withColumns({"stop": F.col("open") - F.col("sign") * F.col("half"), "target": F.col("open") + F.col("sign") * F.col("half"), "trigger": F.col("open") + F.col("sign") * F.col("half") / 2})
    stopped = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    won = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    return rows.withColumns({"stopped": stopped, "won": won, "trade_id": F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / DAY)})


def _tables(spark, d):
    """(trades, orders, bars, ticks, lower quotes)."""
    days = _days(spark, d)
    out = days.filter("stopped or won").withColumns({"reason": F.when(F.col("stopped"), "STOP").otherwise("TARGET"), "exit": F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("target"))})
    cost = F.lit(0.1)
    trades = out.select(
        *KEY, "trade_id", "direction", "signal_ts", F.col("ts").alias("entry_ts"), F.col("open").alias("entry"), "stop", "target", F.col("ts").alias("exit_ts"), "exit", "reason",
        F.lit(2.0).alias("quantity"), (F.col("half") * 2).alias("risk"), cost.alias("entry_cost"), cost.alias("exit_cost"),
        (F.col("sign") * (F.col("exit") - F.col("open")) * 2 - 0.2).alias("pnl"),
    )
    trades = trades.withColumn("r", F.col("pnl") / F.col("risk"))
    hit = F.when(F.col("sign") > 0, F.col("high") >= F.col("trigger")).otherwise(F.col("low") <= F.col("trigger"))
    orders = days.select(*KEY, "signal_ts", F.col("ts").alias("end_ts"), "direction", "trigger", "stop", F.when(hit, "triggered").otherwise("expired").alias("status"))
    quotes = ticks(spark, d).select(*KEY, "ts", F.col("event_id").alias("seq"), F.col("price").alias("bid"), (F.col("price") + F.col("user_id") % 7).alias("ask"))
    return trades, orders, bars(spark, d, DAY), quotes, E.lower_quotes(bars(spark, d, 3600), KEY, 0.5)


def _replayed(spark, d):
    trades, orders, days, quotes, lower = _tables(spark, d)
    return E.replay(trades, orders, days, KEY, DAY, quotes, lower)


_TABLES = f"""{bars_sql('1 day')},
h AS (SELECT symbol, time_bucket(interval '1 hour', ts) AS ts, max(price) AS high, min(price) AS low FROM ticks GROUP BY 1, 2),
d1 AS (SELECT *, CASE WHEN close >= open THEN 1 ELSE -1 END AS sign, (high - low) / 4 AS half, CASE WHEN close >= open THEN 'LONG' ELSE 'SHORT' END AS direction FROM b WHERE high > low),
d2 AS (SELECT *, open - sign * half AS stop, open + sign * half AS target, open + sign * half / 2 AS trigger FROM d1),
d3 AS (SELECT *, CASE WHEN sign > 0 THEN low <= stop ELSE high >= stop END AS stopped, CASE WHEN sign > 0 THEN high >= target ELSE low <= target END AS won,
  CASE WHEN sign > 0 THEN high >= trigger ELSE low <= trigger END AS filled, floor(epoch(ts) / 86400)::BIGINT AS trade_id FROM d2),
trades AS (SELECT symbol, trade_id, direction, sign, ts, open AS entry, stop, target, CASE WHEN stopped THEN 'STOP' ELSE 'TARGET' END AS reason, CASE WHEN stopped THEN stop ELSE target END AS exit,
  half * 2 AS risk, sign * (CASE WHEN stopped THEN stop ELSE target END - open) * 2 - 0.2 AS pnl FROM d3 WHERE stopped OR won),
amb AS (
  SELECT symbol, 'SL_AND_TP_SAME_CANDLE' AS kind, trade_id, direction, ts, stop, target, NULL::DOUBLE AS trigger, 'SL_AND_TP_SAME_CANDLE|' || symbol || '|' || trade_id AS id FROM d3 WHERE stopped AND won
  UNION ALL SELECT symbol, 'PENDING_ENTRY_AND_STOP_SAME_CANDLE', CASE WHEN stopped OR won THEN trade_id END, direction, ts, stop, NULL, trigger,
    'PENDING_ENTRY_AND_STOP_SAME_CANDLE|' || symbol || '|' || strftime(ts - interval '1 day', '%Y-%m-%dT%H:%M:%S') || '-' || direction FROM d3 WHERE filled AND stopped),
quotes AS (
  SELECT 'tick' AS src, symbol, ts, event_id AS seq, price AS bid, price + user_id % 7 AS ask FROM ticks
  UNION ALL SELECT 'low', symbol, ts, 0, low, low + 0.5 FROM h UNION ALL SELECT 'low', symbol, ts, 1, high, high + 0.5 FROM h),
seen AS (
  SELECT src, id, kind, q.ts, bid, ask, row_number() OVER w AS n, CASE WHEN src = 'tick' THEN row_number() OVER w ELSE dense_rank() OVER (PARTITION BY src, id ORDER BY q.ts) END AS pos,
    CASE WHEN direction = 'LONG' THEN ask >= trigger ELSE bid <= trigger END AS at_trigger, CASE WHEN direction = 'LONG' THEN bid <= stop ELSE ask >= stop END AS at_stop,
    CASE WHEN direction = 'LONG' THEN bid >= target ELSE ask <= target END AS at_target
  FROM amb a JOIN quotes q ON q.symbol = a.symbol AND q.ts >= a.ts AND q.ts < a.ts + interval '1 day' WINDOW w AS (PARTITION BY src, id ORDER BY q.ts, seq)),
f AS (SELECT src, id, any_value(kind) AS kind, min(n) FILTER (at_trigger) AS tn, min(pos) FILTER (at_trigger) AS tp, min(n) FILTER (at_stop) AS sn, min(pos) FILTER (at_stop) AS sp,
  min(n) FILTER (at_target) AS gn, min(pos) FILTER (at_target) AS gp FROM seen GROUP BY 1, 2),
g AS (SELECT f.src, f.id, min(s.ts) FILTER (at_stop) AS stop2 FROM f JOIN seen s ON s.src = f.src AND s.id = f.id AND s.pos > f.tp GROUP BY 1, 2),
l AS (SELECT f.src, f.id, CASE WHEN kind LIKE 'P%' THEN CASE WHEN tn IS NOT NULL THEN 'trigger' END WHEN sp < gp OR (sp IS NOT NULL AND gp IS NULL) THEN 'stop' WHEN gp < sp OR (gp IS NOT NULL AND sp IS NULL) THEN 'target' END AS level,
  kind NOT LIKE 'P%' AND coalesce(sp = gp, false) AS tied, tn, sn, gn, g.stop2 FROM f LEFT JOIN g ON g.src = f.src AND g.id = f.id),
e AS (SELECT l.*, s.ts AS event_ts, s.bid, s.ask FROM l LEFT JOIN seen s ON s.src = l.src AND s.id = l.id AND s.n = CASE level WHEN 'trigger' THEN tn WHEN 'stop' THEN sn WHEN 'target' THEN gn END),
r AS (
  SELECT a.*, CASE WHEN k.level IS NOT NULL OR k.tied THEN 'TICK' WHEN w.level IS NOT NULL OR w.tied THEN 'LOWER_TIMEFRAME' ELSE 'BASE_BAR' END AS source,
    coalesce(k.level, '') AS kl, coalesce(k.tied, false) AS kt, coalesce(w.level, '') AS wl, coalesce(w.tied, false) AS wt, k.event_ts AS ke, w.event_ts AS we, k.bid AS kb, w.bid AS wb, k.ask AS ka, w.ask AS wa, k.stop2 AS k2, w.stop2 AS w2
  FROM amb a LEFT JOIN e k ON k.src = 'tick' AND k.id = a.id LEFT JOIN e w ON w.src = 'low' AND w.id = a.id),
resolutions AS (
  SELECT symbol, kind, trade_id, id AS ambiguity_id, direction, ts AS bar_ts, stop, source,
    CASE source WHEN 'TICK' THEN CASE WHEN kt THEN 'STILL_AMBIGUOUS' ELSE 'EXACT_TICK_RESOLUTION' END WHEN 'LOWER_TIMEFRAME' THEN CASE WHEN wt THEN 'STILL_AMBIGUOUS' ELSE 'LOWER_TF_RESOLUTION' END ELSE 'FALLBACK_BASELINE_POLICY' END AS status,
    CASE source WHEN 'TICK' THEN nullif(kl, '') WHEN 'LOWER_TIMEFRAME' THEN nullif(wl, '') ELSE 'stop' END AS touched_level,
    CASE source WHEN 'TICK' THEN ke WHEN 'LOWER_TIMEFRAME' THEN we END AS event_ts,
    CASE source WHEN 'TICK' THEN CASE WHEN kl = 'trigger' AND direction = 'LONG' THEN ka ELSE kb END WHEN 'LOWER_TIMEFRAME' THEN CASE WHEN wl = 'trigger' AND direction = 'LONG' THEN wa ELSE wb END ELSE stop END AS resolved_price,
    CASE source WHEN 'TICK' THEN CASE WHEN kl = 'trigger' THEN k2 END WHEN 'LOWER_TIMEFRAME' THEN CASE WHEN wl = 'trigger' THEN w2 END END AS second_ts FROM r),
moved AS (
  SELECT r.*, t.entry, t.exit, t.reason, t.pnl, t.pnl / t.risk AS pnl_r, t.sign, t.risk, touched_level IN ('stop', 'target') AND resolved_price IS NOT NULL AS new FROM resolutions r JOIN trades t ON t.symbol = r.symbol AND t.trade_id = r.trade_id),
c AS (
  SELECT *, CASE WHEN new THEN resolved_price ELSE exit END AS replay_exit, CASE WHEN new THEN coalesce(event_ts, bar_ts) ELSE bar_ts END AS replay_exit_ts,
    CASE WHEN new THEN (resolved_price - entry) * sign * 2 - 0.2 ELSE pnl END AS replay_pnl, CASE WHEN new THEN (resolved_price - entry) * sign / risk ELSE pnl_r END AS replay_r FROM moved),
comparisons AS (
  SELECT *, CASE WHEN status IN ('STILL_AMBIGUOUS', 'FALLBACK_BASELINE_POLICY') THEN 'STILL_AMBIGUOUS' WHEN (pnl > 0) <> (replay_pnl > 0) THEN 'OUTCOME_CHANGED'
    WHEN coalesce(touched_level = lower(reason), false) THEN 'BASELINE_AMBIGUITY_RESOLVED' WHEN coalesce(new, false) THEN 'EXIT_CHANGED' ELSE 'IDENTICAL' END AS change FROM c)"""


@query(f"""WITH {_TABLES} SELECT symbol, kind, trade_id, direction, bar_ts, status, source, touched_level, event_ts, round(resolved_price, 6) AS resolved_price, second_ts FROM resolutions""")
def replay_resolutions(spark, d):
    found = _replayed(spark, d)["resolutions"]
    return found.select(*KEY, "kind", "trade_id", "direction", "bar_ts", "status", "source", "touched_level", "event_ts", F.round("resolved_price", 6).alias("resolved_price"), "second_ts")


@query(f"""WITH {_TABLES} SELECT symbol, trade_id, kind, change, round(replay_exit, 6) AS replay_exit, replay_exit_ts, round(replay_pnl, 6) AS replay_pnl, round(replay_r, 6) AS replay_r FROM comparisons""")
def replay_comparisons(spark, d):
    found = _replayed(spark, d)["comparisons"]
    return found.select(*KEY, "trade_id", "kind", "change", "replay_exit_ts", *[F.round(c, 6).alias(c) for c in ("replay_exit", "replay_pnl", "replay_r")])


@query(f"""WITH {_TABLES},
per AS (SELECT symbol, trade_id, arg_max(replay_pnl, (kind LIKE 'P%')::INT) AS new_pnl, arg_max(replay_r, (kind LIKE 'P%')::INT) AS new_r FROM comparisons GROUP BY 1, 2),
x AS (SELECT t.pnl, t.pnl / t.risk AS r, coalesce(new_pnl, t.pnl) AS new_pnl, coalesce(new_r, t.pnl / t.risk) AS new_r FROM trades t LEFT JOIN per USING (symbol, trade_id))
SELECT (SELECT count(*) FROM comparisons WHERE change NOT IN ('IDENTICAL', 'STILL_AMBIGUOUS')) AS changed_trades, (SELECT count(*) FROM comparisons WHERE change IN ('IDENTICAL', 'STILL_AMBIGUOUS')) AS unchanged_trades,
  (SELECT count(*) FROM comparisons WHERE pnl > 0 AND replay_pnl <= 0) AS winners_to_losers, (SELECT count(*) FROM comparisons WHERE pnl <= 0 AND replay_pnl > 0) AS losers_to_winners,
  round(sum(new_pnl) - sum(pnl), 5) AS pnl_difference, round(sum(new_r) - sum(r), 5) AS r_difference,
  round(sum(greatest(new_pnl, 0)) / -sum(least(new_pnl, 0)) - sum(greatest(pnl, 0)) / -sum(least(pnl, 0)), 6) AS factor_difference, round(avg(new_r) - avg(r), 6) AS mean_r_difference FROM x""")
def replay_scenario(spark, d):
    found = _replayed(spark, d)["scenario"]
    return found.withColumns({n: F.round(n, 5 if n in ("pnl_difference", "r_difference") else 6) for n in ("pnl_difference", "r_difference", "factor_difference", "mean_r_difference")})


@query(f"""WITH {_TABLES},
n AS (SELECT count(*) AS ambiguous, count(*) AS replayed, count(*) FILTER (status IN ('EXACT_TICK_RESOLUTION', 'LOWER_TF_RESOLUTION')) AS settled FROM resolutions)
SELECT ambiguous, replayed, settled, replayed - settled AS still_ambiguous, (SELECT count(*) FROM comparisons WHERE change = 'OUTCOME_CHANGED') AS outcome_changed,
  (SELECT round(sum(replay_r - pnl_r), 5) FROM comparisons) AS r_change, round(100.0 * settled / replayed, 6) AS settled_percent, round(100.0 * (SELECT count(*) FROM comparisons WHERE change = 'OUTCOME_CHANGED') / replayed, 6) AS outcome_changed_percent FROM n""")
def replay_sensitivity(spark, d):
    found = _replayed(spark, d)["sensitivity"]
    return found.withColumns({"r_change": F.round("r_change", 5), **{f"{n}_percent": F.round(f"{n}_percent", 6) for n in ("settled", "outcome_changed")}})


@query(f"""WITH {_TABLES}, q AS (SELECT symbol, min(ts) AS first_quote, max(ts) AS last_quote FROM ticks GROUP BY 1)
SELECT symbol, first_quote, last_quote, (SELECT count(*) FROM trades t WHERE t.symbol = q.symbol AND t.ts BETWEEN first_quote AND last_quote) AS trades_covered,
  (SELECT count(*) FROM trades t WHERE t.symbol = q.symbol AND NOT t.ts BETWEEN first_quote AND last_quote) AS trades_outside,
  (SELECT count(*) FROM amb t WHERE t.symbol = q.symbol AND t.ts BETWEEN first_quote AND last_quote) AS ambiguities_covered,
  (SELECT count(*) FROM amb t WHERE t.symbol = q.symbol AND NOT t.ts BETWEEN first_quote AND last_quote) AS ambiguities_outside FROM q""")
def replay_coverage(spark, d):
    trades, orders, days, quotes, _ = _tables(spark, d)
    return E.coverage(trades, E.ambiguities(trades, orders, days, KEY), quotes, KEY)


@query(f"""WITH {_TABLES}, t AS (SELECT c.*, t.entry AS price FROM comparisons c JOIN trades t USING (symbol, trade_id)),
s AS (SELECT symbol, trade_id, kind, 1 AS stage_no, 'strategy_signal' AS stage FROM t UNION ALL SELECT symbol, trade_id, kind, 2, 'order_creation' FROM t
UNION ALL SELECT t.symbol, trade_id, t.kind, 3, 'replay_event' FROM t JOIN seen ON src = 'tick' AND id = ambiguity_id
UNION ALL SELECT symbol, trade_id, kind, 4, CASE WHEN touched_level = 'trigger' THEN 'entry_trigger' ELSE 'sl_tp_state' END FROM t WHERE touched_level IS NOT NULL UNION ALL SELECT symbol, trade_id, kind, 5, 'final_resolution' FROM t)
SELECT symbol, kind, stage_no, stage, count(*) AS rows, count(DISTINCT trade_id) AS trades FROM s GROUP BY 1, 2, 3, 4""")
def replay_traces(spark, d):
    trades, orders, days, quotes, lower = _tables(spark, d)
    tables = E.replay(trades, orders, days, KEY, DAY, quotes, lower)
    comparisons, found = tables["comparisons"], E.with_span(tables["ambiguities"], days, KEY, DAY)
    trace = E.forensic_trace(comparisons, trades, found, quotes, KEY, E.TICK).join(found.select("ambiguity_id", "kind"), "ambiguity_id")
    return trace.groupBy(*KEY, "kind", "stage_no", "stage").agg(F.count("*").alias("rows"), F.count_distinct("trade_id").alias("trades"))


@query("""WITH b AS (SELECT event_type AS symbol, time_bucket(interval '1 hour', ts) AS ts FROM events GROUP BY 1, 2), p AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before, ts AS after FROM b),
q AS (SELECT event_type AS symbol, min(ts) AS f, max(ts) AS l FROM events WHERE value > 50 GROUP BY 1)
SELECT p.symbol, before, after, CASE WHEN date_part('hour', after) = 0 THEN 'SESSION_GAP' WHEN before >= f AND after <= l THEN 'REPLAY_DATA_GAP' WHEN f IS NOT NULL THEN 'MISSING_DATA_GAP' ELSE 'MARKET_GAP' END AS gap
FROM p LEFT JOIN q USING (symbol) WHERE epoch(after) - epoch(before) > 3600""")
def replay_gaps(spark, d):
    return E.gaps(bars(spark, d, 3600), ticks(spark, d).filter("raw > 50"), KEY, 3600, F.hour("after") == 0)
