"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of ``edges(a, b)``.

    A round takes the least label over all neighbours, both to the node and to its present root, and
    then the label's own label, so the rounds grow with the logarithm of the longest chain.  Every
    round is an equi-join and a minimum that combines before the shuffle; it ends in a reliable
    checkpoint.  Self links and repeated links do no harm; no edges give no rows.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a != b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer"))
        seen = labels.join(near.withColumnRenamed("a", "node"), "node")
        offers = seen.select("node", "offer").union(seen.select(F.col("root"), "offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(offers, "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = cut_lineage(hooked.join(jump, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("old")).alias("moved")))
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels
