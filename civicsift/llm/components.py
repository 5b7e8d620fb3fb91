"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicsift.session import materialise


def _lowest_neighbours(directed: DataFrame) -> DataFrame:
    """``u, v`` with ``low``: the lowest of ``u`` and its neighbours. Each node's minimum is combined before it
    moves, and the join back can be split where one node has many edges."""
    low = directed.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("node"), F.least("u", "low").alias("low"))
    return directed.join(low, directed["u"] == low["node"]).select("u", "v", "low")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (``u``, ``v``, of one type); the root is the lowest node
    of the component. Edges may repeat and point either way.

    The large star ties all higher neighbours of a node to its lowest one, the small star all lower
    ones; both keep the components, and after a number of rounds that grows with the logarithm of the
    nodes every edge leads to a root. The state of each round is written to the shared folder.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    current = materialise(both.distinct(), "edges")
    before = None
    while (now := _signature(current)) != before:
        before = now
        directed = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest_neighbours(directed).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = _lowest_neighbours(large.filter("u != v").distinct())
        linked = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            small.select("u", F.col("low").alias("v")))
        current = materialise(linked.filter("u != v").distinct(), "edges")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
