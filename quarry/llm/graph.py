"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is one of the nodes, the same for all that are linked.

    Rounds of contraction: each node joins its smallest neighbour or itself, edges inside a group vanish. Node numbers
    should be hashes, so that paths of growing numbers don't arise; then the edges shrink by a constant factor a round.
    No row holds more than one edge, so large components are no larger tasks.
    """
    left, rounds = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    parts = max(1, -(-left.count() // 200_000))  # few files for few edges
    while left.limit(1).count():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")).coalesce(parts))
        rounds.append(to)
        ends = left.join(to, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        ends = ends.join(to, F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
        left = cut(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0].select("node", F.col("to").alias("component"))
    for to in rounds[1:]:
        step = to.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
        out = out.join(step, F.col("component") == F.col("__n"), "left").select("node", F.coalesce("__t", "component").alias("component"))
    return cut(out)
