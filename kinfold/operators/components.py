"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import cut


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root): root is the smallest node reachable. Nodes without an edge don't appear.

    Each round takes the least label among the neighbours and then the label of the label, so a path of n nodes takes
    about log(n) rounds; rounds are checkpointed, and only the number of changes comes to the driver.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(most_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = cut(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        if step.filter("root <> old").limit(1).count() == 0:
            return step.select("node", "root")
        labels = step.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
