"""Connected components in rounds of hooking and pointer jumping, without ever gathering a node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.session import written


def _resolve(spark, parents: DataFrame) -> DataFrame:
    """Pointer jumping: replaces each parent by its own parent until all are roots. parents: node, parent, with parent < node.

    A written round jumps twice over the table that it begins with, so that pointers get three times as long.
    """
    while True:
        a, b = (parents.select(F.col("node").alias(k), F.col("parent").alias(f"over_{k}")) for k in ("parent", "over_parent"))
        x = parents.join(a, "parent", "left").join(b, "over_parent", "left")
        nxt = written(x.select("node", F.coalesce("over_over_parent", "over_parent", "parent").alias("parent"), F.col("over_over_parent").isNotNull().alias("moved")), "jump")
        if nxt.filter("moved").limit(1).count() == 0:
            return nxt.select("node", "parent")
        parents = nxt.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root of every node of edges (columns a, b of one type, no nulls); root is the smallest node of its component.

    Each round hooks a node to its smallest neighbour (a minimum, combined before the shuffle, so a hub costs no more than its
    edges), jumps pointers to the roots, and contracts the edges. Nodes that are not the smallest in their neighbourhood vanish,
    so rounds grow as the logarithm of the nodes. Every round is a written table. Self loops give components of one node.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), "nodes")
    current = nodes.select("node", F.col("node").alias("root"))
    links = edges.select("a", "b").filter("a <> b").distinct()
    links = written(links, "links")
    while links.limit(1).count() > 0:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).filter("parent < node")
        roots = _resolve(spark, written(hooks, "hooks"))
        to = roots.select(F.col("node").alias("root"), F.col("parent").alias("up"))
        current = written(current.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        x = links.join(a, "a", "left").select(F.coalesce("ra", "a").alias("a"), "b").join(b, "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
        links = written(x.filter("a <> b").distinct(), "links")
    return current
