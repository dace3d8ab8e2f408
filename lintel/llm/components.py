"""Connected components of an edge table, without collecting any of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.hot import hot_keys, looked_up
from lintel.llm.storage import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so the
    rounds grow with the logarithm of the longest shortest path. Each round's labels are checkpointed. The edges of a hub,
    and the members of a large component, are never gathered on their key: its label goes to them, and minima are combined
    before they are shuffled.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both, "b")
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        met = looked_up(both, "b", labels.withColumnRenamed("node", "b"), hubs)
        far = met.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = checkpointed(labels.join(far, "node").select("node", "component", F.least("component", "near").alias("next")))
        parent = stepped.select(F.col("node").alias("next"), F.col("next").alias("root"))
        moved = looked_up(stepped, "next", parent, hot_keys(stepped, "next"))
        moved = checkpointed(moved.select("node", F.col("root").alias("component"), (F.col("root") < F.col("component")).alias("moved")))
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
