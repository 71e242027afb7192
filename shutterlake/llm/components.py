"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import forget, hot_limit, spread_join, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): the smallest node of its component.

    Each round takes the least label among a node's neighbours and then that label's own label, so that long chains
    shorten quickly. Nothing but numbers of rows reaches the driver. A node that a third of all links have, as the
    centre of a large group has, sends its label by a broadcast instead of a join on it; so does a label that many
    nodes have. Repeated links and those of a node with itself change nothing; without links there are no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(both, "edges")
    limit = hot_limit(edges.count())
    # A node's links in one direction are as many as in the other.
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "b").alias("label"), "n")
    labels = stored(first, "labels")
    many = hot_limit(labels.count())
    while True:
        facts = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"), "n")
        heard = spread_join(edges, facts, "b", F.col("n") > limit, ["a", "b"]).groupBy("a").agg(F.min("theirs").alias("heard"))
        near = stored(labels.join(heard, labels.node == heard.a).select("node", "n", F.col("label").alias("old"), F.least("label", "heard").alias("via")), "near")
        asked = near.groupBy("via").agg(F.count(F.lit(1)).alias("m"))
        far = asked.join(near.select(F.col("node").alias("via"), F.col("via").alias("beyond")), "via")
        after = spread_join(near, far, "via", F.col("m") > many, ["node"])
        after = stored(after.select("node", "n", "old", F.least("via", "beyond").alias("label")), "labels")
        changed = after.where("label <> old").limit(1).count()
        forget(labels)
        forget(near)
        labels = after
        if not changed:
            forget(edges)
            return labels.select("node", "label")
