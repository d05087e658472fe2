"""Connected components of an edge list, by contraction.

In each round every node hooks to that neighbour, or itself, whose hash is
least; the paths so made are a few steps long, as the order is random anew in
each round, and two jumps follow most of them to the end. The edges are
rewritten between the labels so found. The number of nodes falls by a constant
share in each round, whatever the graph; nothing is collected. A round's
tables are written to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import Scratch


def _jump(label: DataFrame) -> DataFrame:
    """Labels (u, p) followed one step on, by their own labels."""
    return label.join(label.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Null ends and loops are ignored; nodes may be numbers or strings.
    """
    name = "cc" + uuid.uuid4().hex[:12]
    ends = edges.filter(F.col(a) < F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    ends = ends.unionByName(edges.filter(F.col(a) > F.col(b)).select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    # The round is a column of the data, so that the code of each round is the same and compiled once.
    ends = scratch.write(ends.withColumn("k", F.lit(1)), f"{name}-e0")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    found = scratch.write(nodes.withColumn("component", F.col("node")), f"{name}-m0")
    k = 0
    while not ends.isEmpty():
        k += 1
        rank = lambda c: F.struct(F.xxhash64("k", c).alias("h"), F.col(c).alias("x"))
        both = ends.union(ends.select("v", "u", "k"))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("r"), F.max("k").alias("k")).select("u", F.least(rank("u"), "r").getField("x").alias("p"))
        label = scratch.write(_jump(hook), f"{name}-h{k}")
        label = scratch.write(_jump(label).withColumnRenamed("p", "q"), f"{name}-l{k}")
        found = scratch.write(
            found.join(label, found["component"] == label["u"], "left").select("node", F.coalesce("q", "component").alias("component")),
            f"{name}-m{k}",
        )
        moved = ends.join(label.select("u", F.col("q").alias("x")), "u").join(label.select(F.col("u").alias("v"), F.col("q").alias("y")), "v")
        ends = scratch.write(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), (F.col("k") + 1).alias("k")).distinct(), f"{name}-e{k}")
        scratch.drop(f"{name}-e{k - 1}", f"{name}-m{k - 1}", f"{name}-h{k}", f"{name}-l{k}")
    # The smallest node of each component names it.
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))
