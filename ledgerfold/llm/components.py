"""Connected components of links, without bringing any component to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import cut


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour, itself included; links may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them; ``v`` is below ``u``."""
    least = _smallest(edges)
    moved = edges.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of links ``(a, b)``; a component is named by its smallest node.

    Large-star and small-star steps by turns, until they change nothing; the
    number of rounds grows with the logarithm of the number of nodes.  Each round
    is written, so a lost executor never costs more than one.  Links of a node
    with itself or with null say nothing; no links give an empty table.
    """
    straight = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(straight.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") > F.col("v"))).distinct())
    mark = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges)))
        # the sum of hashes tells whether the set of links has changed
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
