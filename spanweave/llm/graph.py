"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import BROADCAST_ROWS, cut_lineage, lookup


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the smallest node of its component.

    Each round every node takes the smallest label around it and then that label's own label, so that labels
    travel along paths in doubling steps. Rounds end when no label changes. Only sums travel to the driver, which
    plans three jobs a round (two more in large graphs): it keeps something of each.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    n = labels.count()
    while True:
        # A hub is the neighbour of many, and a large component has one label: neither may be one task.
        near = lookup(both, labels.withColumnsRenamed({"node": "b", "root": "beside"}), "b", "inner", n).groupBy("a").agg(F.min("beside").alias("near"))
        taken = cut_lineage(labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("next")))
        asked = taken.select(F.col("next").alias("want")).distinct()
        jump = asked.join(taken.select("node", F.col("next").alias("far")), F.col("want") == F.col("node")).select(F.col("want").alias("next"), "far")
        jump = jump if n <= BROADCAST_ROWS else cut_lineage(jump)  # read more than once
        after = cut_lineage(lookup(taken, jump, "next", "inner", n).select("node", "root", F.least("next", "far").alias("new")))
        moved = after.filter("new <> root").limit(1).count()
        labels = after.select("node", F.col("new").alias("root"))
        if not moved:
            return labels
