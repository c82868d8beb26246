"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step reads and writes a table in the shared scratch folder, so lineage stays
short and a lost executor costs one step. Minima are written before they are joined
back, which leaves both join sides plain exchanges that Spark can split when one
node has a large share of the edges. Nothing of the graph reaches the driver but
whether it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.session import Scratch


def _minima(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.write(pairs.groupBy("a").agg(F.min("b").alias("m")), name)


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Joins every neighbour above a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minima(both, scratch, f"{name}_min").select("a", F.least("a", "m").alias("m"))
    return (both.join(low, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Joins a node and its neighbours below it to the least of them (``a > b`` in ``edges``)."""
    low = _minima(edges, scratch, f"{name}_min")
    lower = (edges.join(low, "a").where("b <> m")
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return lower.unionByName(low.withColumnRenamed("m", "b")).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is a centre or has one edge, to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"),
                                  F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .where("up > 1 or (up = 1 and down = 1)").limit(1).count()


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node it is linked with.

    A node that is its component's least is there too. Loops and repeated edges are fine.
    """
    current = scratch.write(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    step = 0
    while not _only_stars(current):
        step += 1
        large = scratch.write(_large_star(current, scratch, f"{name}_{step}l"), f"{name}_{step}l")
        current = scratch.write(_small_star(large, scratch, f"{name}_{step}s"), f"{name}_{step}s")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
