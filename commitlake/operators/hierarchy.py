"""Parent-child links to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent. In each round every node whose pointer has not reached a root takes
over the pointer of the node it points to, so the distance doubles, and appends that node's path segment to its own.
A tree of depth d is done after log2(d) + 1 rounds. When a round settles no node, those left are on or below loops:
pointers go on doubling among these alone until they span as many steps as there are such nodes. Each pointer then
lies on a loop, and the smallest id met on the way round it names that loop.

Rounds are written to the shared folder, which cuts the lineage and survives lost executors. A node that a third of
all others point to makes a skewed join key; the side of the pointers is unique by node, so adaptive execution splits
the skewed partition (spark.sql.adaptive.skewJoin), and no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlake.session import materialise


def links(copies: DataFrame, scope: list[str], node: str, parent: str) -> DataFrame:
    """One row for each node: ``scope``, node, parent.

    Copies of a node may lack its parent; the link is that of any copy that has one (the smallest, should they
    differ). Rows without a node are left out. A parent that is no node itself becomes NULL; a node may be its own
    parent.
    """
    nodes = materialise(copies.where(F.col(node).isNotNull()).groupBy(*scope, F.col(node).alias("node")).agg(F.min(parent).alias("parent")), "nodes")
    known = nodes.select(*scope, F.col("node").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, [*scope, "parent"], "left").select(*scope, "node", F.when(F.col("known"), F.col("parent")).alias("parent"))


def resolve(nodes: DataFrame, scope: list[str], paths: bool = False) -> DataFrame:
    """``scope``, node, root_id, node_depth and, with ``paths``, path (ids from the root to the node) of every node.

    ``nodes`` has one row for each node, as ``links`` makes them. A root has depth 0 and itself as its root. A node on
    or below a loop has depth -1, the smallest id on the loop as root_id and a NULL path. An empty table gives an
    empty result.
    """
    start = materialise(
        nodes.select(
            *scope,
            "node",
            F.coalesce("parent", "node").alias("up"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
            F.col("parent").isNull().alias("done"),
            F.coalesce("parent", "node").alias("least"),
            F.when(F.lit(paths), F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("parent", "node"))).alias("path"),
        ),
        "pointers",
    )
    settled = [start.where("done")]
    roots = start.where("done").select(*scope, F.col("node").alias("up"), F.lit(True).alias("at_root"))
    first = start.where("not done").join(roots, [*scope, "up"], "left").withColumn("done", F.coalesce("at_root", F.lit(False))).drop("at_root")
    now = materialise(first.select(*start.columns), "pointers")
    settled.append(now.where("done"))
    left, span, looping = now.where("not done").count(), 1, False
    while left and not (looping and span >= left):
        open_nodes = now.where("not done")
        table = open_nodes if looping else start.where("done").unionByName(now)
        if len(settled) > 2 and not looping:  # pointers of nodes settled in earlier rounds
            table = now
            for part in settled[:-1]:
                table = table.unionByName(part)
        ahead = table.select(*scope, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"), F.col("least").alias("least2"), F.col("path").alias("path2"))
        moved = open_nodes.join(ahead, [*scope, "up"]).select(
            *scope,
            "node",
            F.col("up2").alias("up"),
            (F.col("steps") + F.col("steps2")).alias("steps"),
            F.col("done2").alias("done"),
            F.least("least", "least2").alias("least"),
            F.when(F.lit(paths) & F.lit(not looping), F.concat("path2", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))).alias("path"),
        )
        now = materialise(moved, "pointers")
        span *= 2
        still = now.where("not done").count()
        looping = looping or still == left
        left = still
        if not looping:
            settled.append(now.where("done"))
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    result = result.select(*scope, "node", F.col("up").alias("root_id"), F.col("steps").alias("node_depth"), "path")
    if left:
        loops = now.where("not done")
        names = loops.select(*scope, F.col("node").alias("up"), F.col("least").alias("root_id"))
        below = loops.join(names, [*scope, "up"]).select(*scope, "node", "root_id", F.lit(-1).cast("bigint").alias("node_depth"), F.lit(None).cast("array<string>").alias("path"))
        result = result.unionByName(below)
    return result if paths else result.drop("path")


def descendants(resolved: DataFrame, scope: list[str]) -> DataFrame:
    """``scope``, ancestor_id, descendant_id, distance of every pair on a common path, from nodes resolved with paths.

    As many rows as the depths add up to: one for each pair asked for, none in between. Nodes on or below loops have
    no path and give none.
    """
    at = F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("place", "ancestor_id")
    pairs = resolved.where(F.col("node_depth") > 0).select(*scope, F.col("node").alias("descendant_id"), "node_depth", at)
    return pairs.select(*scope, "ancestor_id", "descendant_id", (F.col("node_depth") - F.col("place")).cast("bigint").alias("distance"))
