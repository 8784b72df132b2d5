"""Running values and exact ranks over series of any length.

Ordered windows run over (series, chunk). A chunk is one day of time, 65,536 consecutive numbers, or values within 0.1 % of
each other, so a series that holds most rows is still dealt to many tasks. What passes from chunk to chunk is carried by a table
with one row for each chunk of each series. The chunk is a struct, which is never null: rows with null keys stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 65536


def chunked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_chunk``: the series and the day (or block of numbers) of the first column of the order."""
    kind = rows.schema[order[0]].dataType
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        at = F.to_date(order[0])
    elif isinstance(kind, T.NumericType):
        at = F.floor(F.col(order[0]) / SPAN)
    else:
        raise TypeError(f"{order[0]} is neither a time nor a number")
    return rows.withColumn("_chunk", F.struct(*keys, at.alias("_at")))


def running(
    rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: bool = False
) -> DataFrame:
    """Adds sums (a null counts as 0) and maxima of expressions over the rows up to this one, in chunked rows; ``before``
    leaves this row out of the maxima, which are null at the start."""
    sums, maxima = sums or {}, maxima or {}
    local = rows.withColumns({f"_v_{n}": e for n, e in {**sums, **maxima}.items()})
    totals = local.groupBy("_chunk").agg(*[F.sum(f"_v_{n}").alias(n) for n in sums], *[F.max(f"_v_{n}").alias(n) for n in maxima])
    earlier = Window.partitionBy(*[F.col("_chunk")[k] for k in keys]).orderBy(F.col("_chunk")["_at"]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_chunk", *[F.sum(n).over(earlier).alias(f"_b_{n}") for n in sums], *[F.max(n).over(earlier).alias(f"_b_{n}") for n in maxima])
    w = Window.partitionBy("_chunk").orderBy(*order)
    upto, until = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    found = local.join(totals, "_chunk").withColumns({
        **{n: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in sums},
        **{n: F.greatest(f"_b_{n}", F.max(f"_v_{n}").over(until)) for n in maxima},
    })
    return found.drop(*[f"_{p}_{n}" for p in "vb" for n in (*sums, *maxima)])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row in its series, from 1."""
    return running(chunked(rows, keys, order), keys, order, sums={name: F.lit(1)}).drop("_chunk")


def with_overlap(rows: DataFrame, number: str, n: int, size: int = SPAN) -> DataFrame:
    """Deals numbered rows to blocks (``_block``) of at least ``n``; the last ``n`` - 1 rows of a block come into the next one
    as well, where ``_own`` is false."""
    size = max(size, n)
    block = F.floor((F.col(number) - 1) / size)
    guest = (F.col(number) - 1) % size >= size - (n - 1)
    places = F.when(guest, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.select("*", F.posexplode(places).alias("_guest", "_block")).withColumn("_own", F.col("_guest") == 0).drop("_guest")


def value_chunk(value: Column) -> Column:
    """Chunk of a double, rising with it: values of one chunk lie within 0.1 % of each other."""
    size = F.when(F.abs(value) == float("inf"), F.lit(2_000_000)).otherwise(1_000_000 + F.floor(F.log(F.abs(value)) * 1000))
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def cumulative(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row for each distinct value of each group: ``value``, its ``n`` rows, the rows ``below`` it, ``total`` rows of
    the group. Nulls and nans are left out. Equal values are one row before anything is ordered."""
    values = rows.select(*keys, value.cast("double").alias("value")).filter("value is not null and not isnan(value)")
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"_group": F.struct(*keys, F.lit(0).alias("_at")), "_chunk": F.struct(*keys, value_chunk(F.col("value")).alias("_at"))})
    totals = counts.groupBy("_group").agg(F.sum("n").alias("total"))
    ranked = running(counts, keys, ["value"], sums={"_upto": F.col("n")}).join(totals, "_group")
    return ranked.select(*keys, "value", "n", (F.col("_upto") - F.col("n")).alias("below"), "total")


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (interpolated between ranks) of each group, without a list of its values in one place."""
    found, results = [], {}
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("total") - 1)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("value"))).alias(f"_{end}_{name}"))
        results[name] = F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (at - F.floor(at))
    ranks = cumulative(rows, keys, value).groupBy(*keys).agg(F.max("total").alias("total"), *found)
    return ranks.select(*keys, F.col("total").alias("n"), *[c.alias(n) for n, c in results.items()])
