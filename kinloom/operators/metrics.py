"""Reports: precision by phase, truth pairs, confusion, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(a: str, b: str):
    """Two ids in their order."""
    return F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")


def truth_pairs(records: DataFrame) -> DataFrame:
    """All pairs of records of one person; a person has few records, the join is on the person."""
    r = records.select("person_id", "record_id")
    a, b = r.withColumnRenamed("record_id", "left_id"), r.withColumnRenamed("record_id", "right_id")
    return a.hint("merge").join(b, "person_id").where("left_id < right_id").select("left_id", "right_id")


def with_truth(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Matches with sources, names and whether both records are of one person."""
    side = lambda p: records.select(F.col("record_id").alias(f"{p}_id"), F.col("source").alias(f"{p}_source"), F.col("name").alias(f"{p}_name"), F.col("person_id").alias(f"{p}_person"))
    found = matches.join(side("left"), "left_id").join(side("right"), "right_id")
    return found.withColumn("correct", F.col("left_person") == F.col("right_person"))


def precision_by_phase(judged: DataFrame) -> DataFrame:
    """phase, matches, correct, precision; the last row is TOTAL."""
    count = [F.count("*").alias("matches"), F.count_if("correct").alias("correct")]
    by = judged.groupBy("phase").agg(*count)
    total = by.agg(F.sum("matches").alias("matches"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct")).select(F.lit("TOTAL").alias("phase"), F.coalesce("matches", F.lit(0)).alias("matches"), "correct")
    return by.unionByName(total).withColumn("precision", F.when(F.col("matches") > 0, F.col("correct") / F.col("matches")))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two tables of ordered pairs."""
    p, t = predicted.select("left_id", "right_id").distinct().withColumn("p", F.lit(1)), truth.select("left_id", "right_id").distinct().withColumn("t", F.lit(1))
    n = p.join(t, ["left_id", "right_id"], "full").agg(F.count_if(F.expr("p = 1 AND t = 1")).alias("tp"), F.count_if(F.expr("p = 1 AND t IS NULL")).alias("fp"), F.count_if(F.expr("p IS NULL AND t = 1")).alias("fn"))
    precision, recall = F.expr("try_divide(tp, tp + fp)"), F.expr("try_divide(tp, tp + fn)")
    return n.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.expr("try_divide(2 * precision * recall, precision + recall)"))


def tiers(judged: DataFrame) -> DataFrame:
    """Matches and correct ones for each score."""
    return judged.groupBy("score").agg(F.count("*").alias("matches"), F.count_if("correct").alias("correct"))


def missed(truth: DataFrame, predicted: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Truth pairs that were not predicted, by reason (blocking or threshold), by script pair and shared phone."""
    from kinloom.functions import text

    key = ["left_id", "right_id"]
    lost = truth.join(predicted.select(*key).distinct().hint("merge"), key, "left_anti")
    lost = lost.join(candidates.select(*key).distinct().withColumn("seen", F.lit(True)).hint("merge"), key, "left")
    side = lambda p: records.select(F.col("record_id").alias(f"{p}_id"), text.contains_cjk("name").alias(f"{p}_cjk"), F.col("phone").alias(f"{p}_phone")).hint("merge")
    lost = lost.join(side("left"), "left_id").join(side("right"), "right_id")
    script = F.when(F.col("left_cjk") != F.col("right_cjk"), "cross").when(F.col("left_cjk"), "cjk").otherwise("latin")
    return lost.groupBy(F.when(F.col("seen"), "threshold").otherwise("blocking").alias("reason"), script.alias("scripts")).agg(F.count("*").alias("pairs"), F.count_if(F.expr("left_phone = right_phone")).alias("same_phone"))


def size_histogram(members: DataFrame) -> DataFrame:
    """Mean and largest cluster, and how many have two, three, and four or more members."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"), F.count_if(F.expr("n = 2")).alias("two"), F.count_if(F.expr("n = 3")).alias("three"), F.count_if(F.expr("n >= 4")).alias("four_or_more"))


def top(records: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n commonest values; ties by value. The limit is the feature."""
    return records.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
