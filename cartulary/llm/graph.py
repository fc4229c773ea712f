"""Connected components of links between tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.sources.lake import discard, stored

#: Edges of one task: a small graph is kept in few files, a large one in as many as it needs.
EDGES_A_TASK = 1_000_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; a component's name is its smallest node.

    Each round takes the smallest label among a node and its neighbours and then follows the label's own label, so paths
    shrink to half their length; it ends when a round changes nothing. The tables of a round are deleted after the next;
    the last one stays for the result. No edges give an empty table; repeated edges and loops count once.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    pairs = pairs.union(pairs.select("other", "node"))
    pairs = stored(pairs.union(pairs.select("node", F.col("node").alias("other"))).distinct())
    tasks = 1 + pairs.count() // EDGES_A_TASK
    labels = stored(pairs.groupBy("node").agg(F.min("other").alias("component")).coalesce(tasks))
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("component"))
        near = stored(near.coalesce(tasks))
        jump = near.join(near.select(F.col("node").alias("component"), F.col("component").alias("next")), "component")
        after = stored(jump.select("node", F.col("next").alias("component")).coalesce(tasks))
        same = after.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        discard(labels, near)
        labels = after
        if same:
            discard(pairs)
            return labels
