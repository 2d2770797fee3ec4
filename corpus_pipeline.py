"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``language``: documents without a recognised language go: no letter, or a calibrated score below
   ``language.MIN_SCORE``. Where no document has a usable label, only those without a letter (or text) go.
2. ``near_duplicates``: of each component of the Jaccard join one document stays, the one with the smallest id. An id is
   no text: rows that share an id are documents of their own, and stay unless their texts are near copies; so are rows
   without an id. Of documents that tie in id the one with the smallest hash of its text stays, of equal rows any one.
3. ``decontaminate``: documents that the benchmark contaminates go, judged row by row.
4. ``secrets``: each secret is replaced by a mark in the text; no document goes.
5. ``packing``: the documents become pieces in sequences.

All stages but the last return the columns of ``documents``, whatever their names. A table without rows passes as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import common, decontaminate, jaccard, language, packing, secrets
from kinloom.session import release, shelve, tables


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs, language.train(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if jaccard.unique_ids(docs, "doc_id"):
        found = jaccard.near_duplicates(docs)
        return common.restrict(docs, "doc_id", shelve(found.where("component_id <> doc_id").select("doc_id"), "gone", slim=True), "left_anti")
    row = common.fresh(docs.columns, "_row")
    docs = shelve(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.near_duplicates(docs.select(row, "text"), id_col=row)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    first = found.join(docs.select(row, rank.alias("rank")), row).groupBy("component_id").agg(F.min("rank").alias("first"))
    return common.restrict(docs, row, shelve(first.select("first.row"), "first", slim=True), "left_semi").drop(row)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, packing.tokenizer()))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Language identification and packing cannot be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own tables, and the rows before it, are freed as soon as its rows are written."""
    rows = common.table(spark, sf_dir, "documents")
    begun = tables()
    with jaccard.small_batches(spark):
        for name, stage in STAGES[:-1]:
            rows = shelve(stage(spark, rows, sf_dir), name)
            release(since=begun, keep=(name,))
        return STAGES[-1][1](spark, rows, sf_dir)
