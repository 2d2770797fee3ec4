"""The results store: four Parquet tables and a CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("matches", "records", "clusters", "pipeline_stats")


def membership(members: DataFrame, clusters: DataFrame, records: DataFrame) -> DataFrame:
    """cluster_id, record_id, role: attractor or member; each pair once."""
    rows = members.join(clusters.select("cluster_id", "attractor_idx"), "cluster_id").join(records.select("idx", "record_id"), "idx")
    role = F.when(F.col("idx") == F.col("attractor_idx"), "attractor").otherwise("member")
    return rows.select("cluster_id", "record_id", role.alias("role")).dropDuplicates(["cluster_id", "record_id"])


def numbered(matches: DataFrame) -> DataFrame:
    """Matches with an id; ids grow but may leave gaps."""
    return matches.select((F.monotonically_increasing_id() + 1).alias("id"), "left_id", "right_id", "score", "phase", "rule", "classification")


def write(folder: str, **tables: DataFrame) -> None:
    """Each table is replaced as a whole, so a rerun leaves no duplicates."""
    for name, rows in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def export_rows(judged: DataFrame) -> DataFrame:
    """The ten columns of the export, names quoted, ordered by phase and match."""
    level = F.when(F.col("score") == 1.0, "definite").when(F.col("score") == 0.9, "high").when(F.col("score") == 0.7, "medium").otherwise("review")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = judged.select("left_id", "left_source", quoted(F.col("left_name")).alias("left_name"), "right_id", "right_source", quoted(F.col("right_name")).alias("right_name"), "phase", level.alias("confidence"), "rule", "correct")
    return rows.orderBy("phase", "left_id", "right_id")


def export_csv(judged: DataFrame, path: str) -> None:
    export_rows(judged).write.mode("overwrite").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def statistics(spark: SparkSession, rows: list[tuple[str, int, int, int, float]]) -> DataFrame:
    """One row for each phase; a later row of a phase replaces an earlier one."""
    kept = {r[0]: r for r in rows}
    return spark.createDataFrame(list(kept.values()), "phase string, records_consumed long, comparisons long, matches long, elapsed_secs double")
