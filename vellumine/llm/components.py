"""Connected components of an edge table by alternating large-star and small-star steps.

Each step groups by node, takes the smallest neighbour (partial aggregation) and joins it back, so
the neighbours of a hub are never gathered; adaptive execution may split a hub's side of the join.
Steps repeat until the edges stop changing: then each node points at its component's smallest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.scratch import clear, staged, written

SALTS = 4


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    # salted: a hub's edges meet copies of its one row in SALTS tasks, which adaptive execution may split further
    least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    joined = near.join(least, (near["u"] == least["n"]) & (near["salt"] == least["s"])).select("u", "v", "m")
    if large:  # every larger neighbour points at the smallest
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the node and its smaller neighbours point at the smallest
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node."""
    before_all = written()
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = staged(_star(_star(now, True), False), "edges")
        clear(edges.sparkSession, before_all, keep=1)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
