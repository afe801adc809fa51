"""Connected components by contraction.

Each round every node points at its smallest neighbour if that is smaller, pointers are
followed twice, and the edges are rewritten to the nodes pointed at; edges inside one
node vanish. Edges shrink by at least half a round, every table in between is written to
the shared folder, and joins take two plain scans, so that hot hubs are split at run time. Up to
``FEW_EDGES`` edges the pointers (16 bytes each, two for an edge at most) are sent to the tasks instead of shuffling both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import stage

FEW_EDGES = 1 << 19


def _follow(pointers: DataFrame, onto: DataFrame, key: str, few: bool) -> DataFrame:
    """``pointers`` with ``key`` replaced by what ``onto`` (node, root) has for it."""
    other = onto.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    other = F.broadcast(other) if few else other
    return (
        pointers.join(other, F.col(key) == F.col("_n"), "left")
        .withColumn(key, F.coalesce("_r", F.col(key)))
        .drop("_n", "_r")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node."""
    spark = edges.sparkSession
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    rounds: list[tuple[DataFrame, bool]] = []
    while n := left.count():
        few = n <= FEW_EDGES
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        to = stage(to.select("node", F.least("node", "root").alias("root")), "cc-to")
        to = stage(_follow(to, to, "root", few), "cc-to2")
        to = stage(_follow(to, to, "root", few), "cc-to4")
        rounds.append((to, few))
        moved = _follow(_follow(left, to, "a", few), to, "b", few).where("a <> b")
        left = stage(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    out = rounds[0][0]
    for to, few in rounds[1:]:
        out = stage(_follow(out, to, "root", few), "cc-out")
    return out
