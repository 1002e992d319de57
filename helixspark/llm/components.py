"""Connected components of a graph given as a table of links, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.storage import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable, for every node of a link. Nodes are of any type that has an order.

    Each round every node takes the smallest label around it, hands it to the node that its old label names, and
    follows the new label once (pointer jumping), so the number of rounds grows as the logarithm of the longest path.
    """
    one = links.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s <> t")
    edges = stored(one.union(one.select("t", "s")).distinct(), "links", narrow=True)
    labels = stored(edges.groupBy(F.col("s").alias("node")).agg(F.min("t").alias("t")).select("node", F.least("node", "t").alias("label")), "labels", narrow=True)
    while True:
        around = edges.join(labels, edges.s == labels.node).groupBy(F.col("t").alias("node")).agg(F.min("label").alias("label"))
        offers = around.join(labels.withColumnRenamed("label", "old"), "node").select("node", F.least("label", "old").alias("label"), "old")
        # what a node has found is also offered to its former label
        told = offers.select("node", "label").union(offers.where("label < old").select(F.col("old").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        nodes = told.alias("x").join(told.alias("y"), F.col("x.label") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.coalesce(F.col("y.label"), F.col("x.label")).alias("label"))
        found = stored(nodes, "labels", narrow=True)
        changed = found.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = found
        if not changed:
            return labels
