"""Distributed union-find: connected components by randomised contraction.

Each round every node of a remaining edge joins the neighbour (or itself) with the
least hash of that round, and edges are renamed to the chosen nodes.  A constant
share of nodes disappears each round, whatever the shape, so rounds grow with the
logarithm of the nodes.  Neither nodes nor links are ever brought to the driver, and
a hub's edges meet only in aggregates that combine before the shuffle and in joins
that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", limit: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); one root for each component.

    Self links and repeated links are allowed and change nothing; nulls are ignored.
    """
    kind = edges.schema["a"].dataType
    left = scratch.save(edges.where("a is not null and b is not null and a != b").select("a", "b"), f"{tag}-e0")
    steps = []
    for k in range(limit):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))
        best = both.groupBy("node").agg(F.min(rank(F.col("to"))).alias("m"))
        best = best.select("node", F.when(rank(F.col("node")) <= F.col("m"), F.col("node")).otherwise(F.col("m.v")).alias("to"))
        best = scratch.save(best, f"{tag}-m{k}")
        steps.append(best)
        new = left.join(best.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(best.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        new = new.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        new = scratch.save(new, f"{tag}-e{k + 1}")
        scratch.drop(f"{tag}-e{k}")
        left = new
    else:
        raise RuntimeError(f"no convergence in {limit} rounds")
    if not steps:
        return left.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    found = steps[0].withColumnRenamed("to", "root")
    for k, best in enumerate(steps[1:], 1):
        found = found.join(best.select(F.col("node").alias("root"), F.col("to").alias("r2")), "root", "left").select("node", F.coalesce("r2", "root").alias("root"))
        if k % 4 == 0:
            found = scratch.save(found, f"{tag}-f{k}")
    found = scratch.save(found, f"{tag}-roots")
    scratch.drop(*[f"{tag}-{x}{k}" for k in range(len(steps) + 1) for x in "mef"])
    return found
