"""Seed clusters: records that agree on a name key and corroborating fields, in ten passes of falling strictness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.session import shelve

#: Name key, whether the phone and whether the district must agree.
PASSES = [
    ("exact", True, True), ("exact", True, False), ("exact", False, True), ("s_t", True, False), ("s_t", False, True),
    ("stripped", True, False), ("romanized", True, False), ("romanized", False, True), ("stripped", False, False), ("romanized", False, False),
]


def pass_key(name: str, use_phone: bool, use_district: bool) -> Column:
    """The key of a record in a pass; null if its name key is shorter than two bytes or a field is absent."""
    key = F.when(F.octet_length(f"key_{name}") > 1, F.col(f"key_{name}"))
    if use_phone:
        key = F.concat(key, F.lit("|ph:"), F.nullif(F.col("phone"), F.lit("")))
    if use_district:
        key = F.concat(key, F.lit("|d:"), F.lower(F.nullif(F.col("district"), F.lit(""))))
    return key


def seed_members(prepared: DataFrame) -> DataFrame:
    """(idx, cluster_id, pass) of all records that a pass groups; the cluster is named by its smallest idx.

    A pass sees only what earlier passes left. Group sizes come from a map-side count that is joined back, so a hot name
    does not gather in one task. Rows without a key in a pass take no part in its join, they go on as they are. The rows
    are slim: an id, the keys and two fields. Once fewer than two records are left the remaining passes are empty.
    """
    left = prepared.select("idx", "phone", "district", *(f"key_{k}" for k in ("exact", "s_t", "stripped", "romanized")))
    found = None
    for number, spec in enumerate(PASSES, 1):
        keyed = left.withColumn("_key", pass_key(*spec))
        has, none = keyed.where("_key IS NOT NULL"), keyed.where("_key IS NULL").drop("_key")
        groups = has.groupBy("_key").agg(F.min("idx").alias("cluster_id"), F.count("*").alias("size"))
        state = has.join(groups, "_key").drop("_key").withColumn("cluster_id", F.when(F.col("size") >= 2, F.col("cluster_id"))).drop("size")
        state = shelve(state.unionByName(none.withColumn("cluster_id", F.lit(None).cast("long"))), f"pass{number}", slim=True)
        hit = state.where("cluster_id IS NOT NULL").select("idx", "cluster_id", F.lit(number).alias("pass"))
        found = hit if found is None else found.union(hit)
        left = state.where("cluster_id IS NULL").drop("cluster_id")
        if len(left.take(2)) < 2:
            break
    return found


def clusters(members: DataFrame, prepared: DataFrame) -> DataFrame:
    """One row for each cluster: size, richness (ten more for each member), attractor (the richest member, ties: the
    highest idx), its surname key, and whether the phone corroborates the cluster."""
    rows = members.join(prepared.select("idx", "richness", "surname_key"), "idx")
    best = F.max(F.struct("richness", "idx", "surname_key")).alias("best")
    phone = F.array_contains(F.array(*(F.lit(i) for i, p in enumerate(PASSES, 1) if p[1])), F.col("pass"))
    found = rows.groupBy("cluster_id").agg(F.min("pass").alias("pass"), F.count("*").alias("size"), (F.sum("richness") + 10 * F.count("*")).alias("richness"), best)
    return found.select("cluster_id", "pass", "size", "richness", F.col("best.idx").alias("attractor_idx"), F.col("best.surname_key").alias("surname_key"), phone.alias("phone_corroborated"))
