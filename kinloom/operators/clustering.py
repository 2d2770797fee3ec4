"""Clusters of matched records: connected components, with the results that lie inside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components


def clusters(matches: DataFrame, with_possible: bool = False) -> DataFrame:
    """(cluster_id, record_id) of all records that a match links (possible ones too if asked); at least two each. The
    cluster is named by its smallest record id."""
    kinds = ["match", "possible"] if with_possible else ["match"]
    edges = matches.where(F.col("classification").isin(*kinds))
    return connected_components(edges, "left_id", "right_id").select(F.col("component").alias("cluster_id"), F.col("node").alias("record_id"))


def edges_inside(members: DataFrame, results: DataFrame) -> DataFrame:
    """All results, non-matches as well, whose two ends are in one cluster: cluster_id and the columns of a result."""
    side = lambda p: members.select(F.col("record_id").alias(f"{p}_id"), F.col("cluster_id").alias(f"_{p}"))
    found = results.join(side("left"), "left_id").join(side("right"), "right_id").where("_left = _right")
    return found.withColumnRenamed("_left", "cluster_id").drop("_right")
