"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import written


def connected_components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has a link: rows (node, component).

    Alternates two steps until nothing changes, in rounds that grow with the logarithm of the longest path. Large star:
    every node hangs its larger neighbours on the smallest node it sees. Small star: every node hangs its smaller
    neighbours, and itself, on the smallest. Each step is a minimum by key (combined before the shuffle) and a join;
    no neighbour list is ever gathered. Rounds are written to the shared folder, so lost executors cost little.
    Self-links and null ends are ignored; no links give no rows."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.filter(a.isNotNull() & b.isNotNull() & (a != b))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(hung.filter("u != v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
