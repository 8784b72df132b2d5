"""Values carried over chunks equal those of one pass over the series."""

import random
import statistics

from pyspark.sql import functions as F

from tidemill.operators import carry, metrics, reports


def logs(n=400):
    """One series holds most rows and spans many chunks; one has a null name and one a single row."""
    rnd = random.Random(3)
    rows = [("hot", i * 9_000, float(rnd.randint(-3, 3))) for i in range(n)]
    return rows + [(None, i * 40_000, float(rnd.randint(-3, 3))) for i in range(20)] + [("one", 5, -1.0)]


def by_series(rows):
    out = {}
    for key, at, value in sorted(rows, key=lambda x: x[1]):
        out.setdefault(key, []).append(value)
    return out


def test_running_values(spark):
    rows = logs()
    df = carry.chunked(spark.createDataFrame(rows, "symbol string, n long, r double"), ["symbol"], ["n"])
    df = carry.running(df, ["symbol"], ["n"], sums={"total": F.col("r")}, maxima={"high": F.col("r")})
    df = carry.running(df, ["symbol"], ["n"], maxima={"high_before": F.col("r")}, before=True)
    found = {(x["symbol"], x["n"]): x for x in df.collect()}
    assert len(found) == len(rows)
    seen = {}
    for key, at, value in sorted(rows, key=lambda x: x[1]):
        past = seen.setdefault(key, [])
        row = found[(key, at)]
        assert row["high_before"] == (max(past) if past else None)
        past.append(value)
        assert (row["total"], row["high"]) == (sum(past), max(past))


def test_rolling_over_blocks(spark):
    rows = [("hot", i, float(i * 7919 % 101)) for i in range(1, 200)]
    df = carry.numbered(spark.createDataFrame(rows, "symbol string, n long, r double"), ["symbol"], ["n"], "_no")
    dealt = carry.with_overlap(df, "_no", 5, 20)
    assert dealt.filter("_own").count() == len(rows)
    assert dealt.groupBy("_block").count().agg(F.max("count")).first()[0] == 24
    found = metrics.worst_rolling(df, ["symbol"], ["n"], 5).first()["worst_rolling"]
    values = [v for _, _, v in rows]
    assert found == min(sum(values[i : i + 5]) for i in range(len(values) - 4))


def test_recovery_and_streaks(spark):
    df = spark.createDataFrame(logs(), "symbol string, n long, r double").filter("symbol is not null")
    longest = {x["symbol"]: x["longest_recovery"] for x in metrics.longest_recovery(df, ["symbol"], ["n"]).collect()}
    wins = {x["symbol"]: x["max_wins"] for x in metrics.streaks(df, ["symbol"], ["n"], "r").collect()}
    for key, values in by_series([x for x in logs() if x[0]]).items():
        total = high = peak = best = run = most = 0
        under_before = False
        for i, v in enumerate(values, 1):
            total += v
            under = total < high
            if under or under_before:
                best = max(best, i - peak)
            if not under:
                peak, high = i, max(high, total)
            under_before = under
            run = run + 1 if v > 0 else 0
            most = max(most, run)
        assert (longest[key], wins[key]) == (best, most)


def test_exact_percentiles(spark):
    rows = [("a", v) for v in [-5.0, -1.0, -1.0, 0.0, 2.0, 2.0, 1e9, float("inf"), None, float("nan")]] + [("b", 3.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, v double")
    found = {x["symbol"]: x for x in carry.percentiles(df, ["symbol"], F.col("v"), {"p25": 0.25, "median": 0.5}).collect()}
    want = [-5.0, -1.0, -1.0, 0.0, 2.0, 2.0, 1e9, float("inf")]
    assert found["a"]["n"] == 8 and found["a"]["median"] == statistics.median(want) and found["a"]["p25"] == -1.0
    assert found["b"]["median"] == 3.0 and found[None]["median"] == 2.5
    assert carry.percentiles(df.limit(0), ["symbol"], F.col("v"), {"median": 0.5}).count() == 0
    tail = reports.tail_loss(df.filter("symbol = 'a'"), ["symbol"], "v", 0.25).first()
    assert tail["n"] == 2 and tail["tail_mean"] == -3.0
