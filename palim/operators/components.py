"""Connected components by labels that sink to the least node and jump along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.sources.store import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for each node of edges (a, b).

    A round gives each node the least label among its own and its neighbours', then that label's label. A node of many edges
    costs a row for each task, since minima are taken before the shuffle; each round is a table of one row a node.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("to")).agg(F.min("root").alias("least"))
        sunk = labels.join(heard, F.col("node") == F.col("to")).select("node", F.least("root", "least").alias("next"), F.col("root").alias("last"))
        over = labels.select(F.col("node").alias("via"), F.col("root").alias("onward"))
        after = stored(sunk.join(over, F.col("next") == F.col("via")).select("node", F.least("next", "onward").alias("root"), (F.least("next", "onward") < F.col("last")).alias("moved")))
        if not after.filter("moved").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")
