"""Connected components of an edge table by alternating large and small stars.

Each round is two keyed minima (combined map-side) and two joins of written
tables, so no node's neighbours ever meet in one task. The number of rounds
grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.tables import materialise
from sightline.session import delete_path

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """``edges`` hold u > v. Large star: every larger neighbour of a node is
    linked to the node's smallest neighbour. Small star: the node and its
    smaller neighbours are linked to the smallest."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least, least_path = materialise(
        both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least"
    )
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    result, _ = materialise(out.where("u <> v").distinct(), name)
    delete_path(spark, least_path)
    return result


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its
    component. ``edges`` has columns ``a`` and ``b`` in any order."""
    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, _ = materialise(directed, "cc-edges")
    before = _signature(current)
    for round_no in range(MAX_ROUNDS):
        current = _star(_star(current, True, f"cc-large{round_no}"), False, f"cc-small{round_no}")
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
