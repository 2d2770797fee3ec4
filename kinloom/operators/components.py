"""Connected components of an undirected graph, as iterated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.session import shelve


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Each round hands the smallest known label of the closed neighbourhood to all neighbours and then lets every node
    take the label of its label (pointer jumping), so a chain of n nodes needs about log n rounds. Labels only fall;
    the loop ends when no label changes. Labels are aggregated before they are shuffled, so a node with very many
    edges costs one row for each task. Each round is written to the shared folder. Loops and repeated edges do no
    harm; rows with a null end are ignored.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = shelve(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = shelve(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    for _ in range(max_rounds):
        offered = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, labels.node == offered.a).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        target = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = lower.join(target, lower.label == target.at, "left").select("node", "old", F.least("label", "further").alias("label"))
        after = shelve(jumped, "labels")
        labels = after.select("node", "label")
        if not after.where("label <> old").head(1):
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")
