"""Scans of person records, ground truth and rules; content hashes and kept stages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the input (files in order); the header, which begins with record_id, goes."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), "value").where("NOT startswith(value, 'record_id,')")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV person records: at most six fields, five at least; ``;`` in a name stands for a comma; empty means absent."""
    part = F.split("value", ",", 6)
    rows = _lines(spark, path).where(F.size(part) >= 5)
    field = lambda i: F.nullif(F.trim(F.get(part, F.lit(i))), F.lit(""))
    return rows.select("idx", F.get(part, F.lit(0)).alias("record_id"), F.get(part, F.lit(1)).alias("source"), F.coalesce(F.expr("try_cast(split(value, ',', 6)[2] AS bigint)"), F.lit(-1)).alias("person_id"), F.translate(F.get(part, F.lit(3)), ";", ",").alias("name"), field(4).alias("district"), field(5).alias("phone"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The records with their person (-1 if it is no number); four fields at least; the first line of an id wins."""
    part = F.split("value", ",", 6)
    rows = _lines(spark, path).where(F.size(part) >= 4)
    get = lambda i: F.get(part, F.lit(i))
    rows = rows.select("idx", get(0).alias("record_id"), get(1).alias("source"), F.coalesce(F.expr("try_cast(split(value, ',', 6)[2] AS bigint)"), F.lit(-1)).alias("person_id"), F.translate(get(3), ";", ",").alias("name"), F.coalesce(get(4), F.lit("")).alias("district"), F.coalesce(get(5), F.lit("")).alias("phone"))
    first = rows.groupBy("record_id").agg(F.min_by(F.struct("source", "person_id", "name", "district", "phone"), "idx").alias("r"))
    return first.select("record_id", "r.*")


def read_sample(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Lines of six fields at least, the first ``n`` in file order; ``;`` stays. The limit is the feature."""
    part = F.split("value", ",")
    rows = _lines(spark, path).where(F.size(part) >= 6)
    rows = rows.orderBy("idx").limit(n) if n else rows
    get = lambda i: F.get(part, F.lit(i))
    return rows.select("idx", get(0).alias("record_id"), get(1).alias("source"), F.expr("try_cast(split(value, ',')[2] AS bigint)").alias("person_id"), get(3).alias("name"), F.nullif(get(4), F.lit("")).alias("district"), F.nullif(get(5), F.lit("")).alias("phone"))


def truth_groups(records: DataFrame) -> DataFrame:
    """person_id and the set of its record ids."""
    return records.groupBy("person_id").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"))


def write_records(records: DataFrame, path: str) -> None:
    """The CSV form that ``read_records`` reads."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    name = F.translate("name", ",", ";")
    records.select(F.concat_ws(",", "record_id", "source", F.col("person_id").cast("string"), name, blank("district"), blank("phone")).alias("value")).write.text(path)


def content_hash(records: DataFrame, fields: list[str] | None = None) -> int:
    """A number that does not depend on the order of rows or columns: count and xor of row hashes."""
    fields = sorted(fields or [c for c in records.columns if c != "idx"])
    row = F.xxhash64(*(F.concat_ws("=", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) for c in fields))
    found = records.agg(F.count("*").alias("n"), F.bit_xor(row).alias("h"), F.bit_xor(F.xxhash64(row)).alias("g")).first()
    return hash((found["n"], found["h"], found["g"]))


def cached(spark: SparkSession, folder: str, key: int, make) -> DataFrame:
    """The table in ``folder`` if it was written under the same key, else the one that ``make`` returns, written."""
    path = f"{folder}/{key & (1 << 64) - 1:016x}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_rules(path: str) -> list[dict]:
    """Rules of a JSON file: {version, rules: [{condition, confidence}]}; other keys are ignored."""
    with open(path, encoding="utf-8") as file:
        return [{"condition": r["condition"], "confidence": r["confidence"]} for r in json.load(file)["rules"]]


def write_rules(path: str, rules: list[dict], **about) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"version": "1.0", **about, "rules": rules}, file, indent=2, ensure_ascii=False)
