"""Connected components of a stored table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a long, b long); component is the least node reachable.

    In each round a node takes the least label among itself and its neighbours
    (summed on the map side, so a node with very many links is no hot spot) and
    offers it to the node that its old label names, so that a whole settled
    tree is hooked at once; then every node takes the label of its label.
    Every round is a written table; only the number of changed labels comes to
    the driver. Rounds go on until no label changes, whatever their number:
    some 20 for a chain of 100,000 nodes, in whatever order their ids lie.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        told = near.join(labels, near["a"] == labels["node"]).select("node", "component", F.least("near", "component").alias("to"))
        own = told.select("node", "to", F.col("component").alias("before"))
        # the old label's own node is told too; it has no "before" here
        roots = told.where("to < component").select(F.col("component").alias("node"), "to", F.lit(None).cast("long").alias("before"))
        hooked = own.unionByName(roots).groupBy("node").agg(F.min("to").alias("to"), F.max("before").alias("before"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = hooked.join(jump, "to").select("node", F.least("to", "further").alias("component"), "before")
        after = stored(after, "labels")
        labels = after.select("node", "component")
        if not after.where("component <> before").count():
            return labels
