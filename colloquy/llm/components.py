"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component; ``links`` has long columns a and b.

    Each node first goes to its least neighbour, and links between the nodes that are left, which are few, are followed
    to their ends.  A path of links stays one on the way, so that no component falls apart.
    """
    links = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = links.select("a", F.col("b").alias("node")).union(links.select("a", F.col("a").alias("node")))
    near = cut_lineage(ends.groupBy("node").agg(F.min("a").alias("near")))
    to = lambda end, name: near.select(F.col("node").alias(end), F.col("near").alias(name))
    left = links.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = propagated(left).withColumnRenamed("node", "near")
    return near.join(roots, "near", "left").select("node", F.coalesce("root", "near").alias("root"))


def propagated(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component; ``links`` has long columns a and b.

    Each round gives a node the least label among its neighbours' and then that label's own
    label, so that chains halve.  Labels are joined and pre-aggregated, never gathered: a node with
    many links is one row before its join and a partial minimum after it.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        new = near.join(jump, "root").select("node", F.least("root", "onward").alias("root"), (F.col("was") != F.least("root", "onward")).alias("moved"))
        new = cut_lineage(new)
        if not new.where("moved").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
