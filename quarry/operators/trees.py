"""Trees given as rows (node, parent): what holds on the way from each node up to its root.

Rows look further up in rounds that double their reach (pointer jumping), so a tree of depth d takes about log2(d) joins,
chains as well as flat trees. A row is finished once nothing above it can change its answer; only the others are joined
again. A parent that very many rows share is one key of that join: such keys are salted on the side of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import small
from quarry.sources.tables import settled

#: Rows of one parent from which it is salted, and into how many keys.
HOT, SALTS = 100_000, 64


def _lift(rows: DataFrame, known: DataFrame, hot: int) -> DataFrame:
    """rows (with `up`) beside the known row of that node, its columns prefixed with t_; a parent of more than `hot` rows in several keys."""
    t = known.select(*[F.col(c).alias(f"t_{c}") for c in known.columns])
    many = settled(rows.groupBy("up").count().where(F.col("count") > hot).select(F.col("up").alias("m_up")))
    if not many.limit(1).count():
        return rows.join(t, F.col("up") == F.col("t_node"), "left")
    many = small(many)
    salt = F.when(F.col("m_up").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.lit(SALTS))).cast("int")
    left = rows.join(many, F.col("up") == F.col("m_up"), "left").withColumn("salt", salt).drop("m_up")
    copies = F.when(F.col("m_up").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = t.join(many, F.col("t_node") == F.col("m_up"), "left").withColumn("t_salt", F.explode(copies)).drop("m_up")
    return left.join(right, (F.col("up") == F.col("t_node")) & (F.col("salt") == F.col("t_salt")), "left").drop("salt", "t_salt")


def climb(nodes: DataFrame, *, stop: Column | None = None, cut: Column | None = None, label: Column | None = None, node: str = "node", parent: str = "parent", hot: int = HOT) -> DataFrame:
    """node, nearest, excluded, path, whole for each row of nodes.

    nearest: the nearest of the node and its ancestors that meets `stop` (null: none does). excluded: one of them meets `cut`, so the
    node lies in a branch that is left out; what else is told of such a node is of no meaning. path: their labels from the root down.
    Ways end at a null parent, and at one that has no row. whole is false where they don't end, as in and below a cycle. Nodes without a
    name are left out, of rows with the same name one is kept. Null conditions are not met. An empty table gives no rows.
    """
    rows = nodes.where(F.col(node).isNotNull()).select(
        F.col(node).alias("node"), F.col(parent).alias("up"), F.when(stop, F.col(node)).alias("near") if stop is not None else F.lit(None).cast(nodes.schema[node].dataType).alias("near"),
        F.coalesce(cut, F.lit(False)).alias("out") if cut is not None else F.lit(False).alias("out"), F.array(label).alias("path") if label is not None else F.lit(None).cast("array<string>").alias("path"),
    )
    known = settled(rows.dropDuplicates(["node"]))
    # Nothing above can matter: the way has ended, the branch is out, or only the nearest is asked for and found.
    done = F.col("up").isNull() | F.col("out")
    if cut is None and label is None:
        done = done | F.col("near").isNotNull()
    finished, left = [known.where(done)], known.where(~done)
    for _ in range(known.count().bit_length() + 1):
        if not left.limit(1).count():
            break
        met = _lift(left, known, hot)
        path = F.concat(F.coalesce("t_path", F.array().cast("array<string>")), "path") if label is not None else F.col("path")
        met = settled(met.select("node", F.col("t_up").alias("up"), F.coalesce("near", "t_near").alias("near"), (F.col("out") | F.coalesce("t_out", F.lit(False))).alias("out"), path.alias("path")))
        # A row that is finished early knows what it needs; what lies above it is taken from those still on the way.
        finished.append(met.where(done))
        left = met.where(~done)
        known = left
        for part in finished:
            known = known.unionByName(part)
    out = left.withColumn("whole", F.lit(False))
    for part in finished:
        out = out.unionByName(part.withColumn("whole", F.lit(True)))
    return out.select("node", F.col("near").alias("nearest"), F.col("out").alias("excluded"), "path", "whole")


def by_container(nodes: DataFrame, *, leaf: Column, container: Column, cut: Column | None = None, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, container: each leaf with the nearest of its ancestors that is a container (null: none), branches under a `cut` node left out.

    Only nodes that are a parent of some row climb, mostly few beside the leaves; each leaf then takes over what its parent knows, in one join.
    """
    parents = nodes.select(F.col(parent).alias("__up")).where("__up is not null").distinct()
    inner = nodes.withColumn("__leaf", leaf).join(parents, F.col(node) == F.col("__up"), "left_semi")
    found = settled(climb(inner, stop=container & ~F.col("__leaf"), cut=cut, node=node, parent=parent).select("node", "nearest", "excluded"))
    out = F.coalesce(cut, F.lit(False)) if cut is not None else F.lit(False)
    leaves = nodes.where(leaf & F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up"), out.alias("out")).dropDuplicates(["node"]).where("not out")
    return _lift(leaves, found, HOT).where(~F.coalesce("t_excluded", F.lit(False))).select("node", F.col("t_nearest").alias("container"))
