"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links`` (``a``, ``b``): columns ``node``, ``component``.

    Every round takes the smallest label among the neighbours and then follows labels of
    labels, so the number of rounds grows with the logarithm of a chain's length. The labels of a round
    are written before the next reads them; nothing is collected but the number of
    labels that changed. Minima are taken before rows are shuffled, so a node with very
    many neighbours is no burden to one task.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, "links")
    own = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = stored(own.select("node", F.least("node", "near").alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        of_neighbours = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        near = of_neighbours.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        lowered = stored(lowered, "labels")
        target = lowered.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = lowered.join(target, "component", "left").select(
            "node", F.least("component", "further").alias("component"), "old"
        )
        labels = stored(jumped.select("node", "component", (F.col("component") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "component")
