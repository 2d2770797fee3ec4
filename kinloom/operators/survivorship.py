"""Golden records: for each field of a cluster one surviving value, with its provenance."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MostComplete:
    """The longest value in bytes that is not empty; ties: the last member."""

    name: str = "most_complete"

    def rank(self, value: Column, source: Column, position: Column, first_of_source: Column) -> Column:
        return F.when(value != "", _rank(F.octet_length(value), position))


@dataclass(frozen=True)
class MostTrustedSource:
    """The value of the first member of the most trusted source; if that member lacks the field, the next source."""

    sources: tuple[str, ...]
    name: str = "most_trusted_source"

    def rank(self, value: Column, source: Column, position: Column, first_of_source: Column) -> Column:
        place = F.coalesce(*(F.when(source == s, F.lit(-i)) for i, s in enumerate(self.sources)), F.lit(None).cast("int"))
        return F.when(value.isNotNull() & first_of_source & place.isNotNull(), _rank(place, F.lit(0)))


def _rank(high: Column, low: Column) -> Column:
    return F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))


Rule = MostComplete | MostTrustedSource


def golden_records(members: DataFrame, fields: list[str], default: Rule, by_field: Mapping[str, Rule] | None = None) -> DataFrame:
    """``members``: cluster_id, position, record_id, source and ``fields``. One row for each cluster and field that has
    a surviving value: cluster_id, field, value, source_record_id, source_system, rule.

    All fields go through the same two aggregations, both with a map-side part: equal values of a cluster become one,
    which knows its rank and its first holder, and the highest rank survives. The record and system are those of the
    first member that holds the winning value.
    """
    rules = {f: (by_field or {}).get(f, default) for f in fields}
    rows = members
    if any(isinstance(r, MostTrustedSource) for r in rules.values()):
        firsts = members.groupBy("cluster_id", "source").agg(F.min("position").alias("position")).withColumn("_first", F.lit(True))
        rows = members.join(firsts, ["cluster_id", "source", "position"], "left")
    first = F.coalesce("_first", F.lit(False)) if "_first" in rows.columns else F.lit(False)
    parts = [
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), r.rank(F.col(f), F.col("source"), F.col("position"), first).alias("rank"), F.lit(r.name).alias("rule"))
        for f, r in rules.items()
    ]
    rows = rows.select("cluster_id", "position", "record_id", "source", F.explode(F.array(*parts)).alias("p")).select("*", "p.*").where("value IS NOT NULL")
    held = F.min_by(F.struct("record_id", "source"), "position").alias("from")
    values = rows.groupBy("cluster_id", "field", "value", "rule").agg(F.max("rank").alias("rank"), held).where("rank IS NOT NULL")
    won = values.groupBy("cluster_id", "field", "rule").agg(F.max_by(F.struct("value", "from"), "rank").alias("w"))
    return won.select("cluster_id", "field", "w.value", F.col("w.from.record_id").alias("source_record_id"), F.col("w.from.source").alias("source_system"), "rule")


def as_maps(golden: DataFrame) -> DataFrame:
    """One row for each golden record: id, cluster_id, fields (map of structs)."""
    entry = F.struct(F.col("field").alias("key"), F.struct("value", "source_record_id", "source_system", "rule").alias("value"))
    return golden.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields")).select(F.concat(F.lit("golden_"), F.col("cluster_id").cast("string")).alias("id"), "cluster_id", "fields")
