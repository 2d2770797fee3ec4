"""The whole resolution: prepare, seed, validate, assign, match the remainder, report."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.dictionaries import Dictionaries, from_icu
from kinloom.operators import matching, seeds
from kinloom.operators.prepare import prepare
from kinloom.session import shelve
from kinloom.sources import records as sources


@dataclass
class Resolution:
    prepared: DataFrame
    members: DataFrame
    clusters: DataFrame
    matches: DataFrame

    def final_clusters(self) -> DataFrame:
        """The clusters with the members that were assigned later: size and richness anew, attractor as before."""
        rows = self.members.join(self.prepared.select("idx", F.col("richness").alias("r")), "idx")
        now = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), (F.sum("r") + 10 * F.count("*")).alias("richness"))
        return self.clusters.drop("size", "richness").join(now, "cluster_id")

    def states(self) -> DataFrame:
        """record_id and merged (in a match of high confidence), unresolved (in a cluster, unmatched) or singleton."""
        good = self.matches.where("score >= 0.9")
        merged = good.select(F.col("left_id").alias("record_id")).union(good.select("right_id")).distinct().withColumn("m", F.lit(True))
        rows = self.prepared.select("idx", "record_id").join(self.members.select("idx").distinct().withColumn("c", F.lit(True)), "idx", "left").join(merged, "record_id", "left")
        return rows.select("record_id", F.when(F.col("m"), "merged").when(F.col("c"), "unresolved").otherwise("singleton").alias("state"))


def resolve(records: DataFrame, dictionaries: Dictionaries | None = None, json_rules: list[dict] | None = None, job: str | None = None) -> Resolution:
    """Seed clusters by keys, validate them, assign what is left to clusters, match the rest in blocks.

    Each stage's table is written once and read by the next ones, so nothing is computed twice and lineage stays
    short. Rules are the built-in cascade unless ``json_rules`` are given. With a ``job`` folder the stages are kept there
    under a hash of the records and the rules: a job that was broken off goes on after its last whole stage, and one that
    is done is read.
    """
    spark = records.sparkSession
    d = dictionaries or from_icu(spark)
    key = sources.content_hash(records) ^ zlib.crc32(json.dumps(json_rules, sort_keys=True).encode()) if job else 0

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return sources.cached(spark, f"{job}/{name}", key, make) if job else shelve(make(), name)

    prepared = stage("prepared", lambda: prepare(records, d))
    seeded = stage("members", lambda: seeds.seed_members(prepared))
    found = stage("clusters", lambda: seeds.clusters(seeded, prepared))
    left = prepared.join(seeded.select("idx"), "idx", "left_anti")
    assigned = stage("assigned", lambda: matching.assign(left, found, prepared, d, json_rules))
    members = seeded.unionByName(assigned.select("idx", "cluster_id", F.lit(0).alias("pass")))
    rest = stage("rest", lambda: left.join(assigned.select("idx"), "idx", "left_anti"))
    phases = (
        lambda: matching.validate_members(seeded, found, prepared, d, json_rules),
        lambda: matching.assigned_matches(assigned),
        lambda: matching.match_blocks(rest, d, json_rules),
    )
    matches = stage("matches", lambda: reduce(DataFrame.unionByName, (p() for p in phases)))
    return Resolution(prepared, members, found, matches)


def collision_pool(prepared: DataFrame, name_key: str = "key_romanized", field: str = "phone", most: int = 3) -> DataFrame:
    """For each record how many share its name and its value of a field, and whether that is few enough to trust."""
    counts = prepared.where(F.col(field).isNotNull()).groupBy(name_key, field).agg(F.count("*").alias("sharing"))
    return prepared.select("record_id", name_key, field).join(counts, [name_key, field], "left").select("record_id", F.coalesce("sharing", F.lit(0)).alias("sharing"), (F.coalesce("sharing", F.lit(0)) <= most).alias("trusted"))
