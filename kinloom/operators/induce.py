"""Rule induction: greedy cover of the matching pairs by conditions of high precision."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators import rules

# The conditions that rules are made of, in the order that decides ties, and the bounds of the search.
CONDITIONS = [
    "family_exact && given_exact", "family_exact && given_st", "family_st && given_st", "family_st", "family_exact", "given_exact", "given_st",
    "family_romanization && given_romanization", "family_romanization", "given_romanization", "family_match && phone_match",
    "family_match && email_match", "family_exact && phone_match", "given_jw > 0.85", "given_jw > 0.9", "given_partial",
]
ROUNDS, STRICT_ROUNDS, STRICT, LOOSE, LEAST = 30, 3, 0.95, 0.80, 5


def evaluator(condition: str) -> Column:
    """The condition language of induction: a leading comparison of given_jw, then &&, then ||, then an atom.

    A comparison of given_jw at the start takes the whole text, so a conjunction that begins with one never holds; an
    unknown atom never holds.
    """
    text = condition.strip()
    if text.startswith("given_jw >"):
        try:
            return F.col("given_jw") > float(text[len("given_jw >") :])
        except ValueError:
            return F.lit(False)
    for mark, join in ((" && ", lambda x, y: x & y), (" || ", lambda x, y: x | y)):
        if mark in text:
            first, *rest = (evaluator(p) for p in text.split(mark))
            for other in rest:
                first = join(first, other)
            return first
    known = [a for a in rules.ATOMS if a not in ("given_jw", "given_bigram_jaccard", "district_match")]
    return rules.atom(text) if text in known else F.lit(False)


def candidates() -> list[str]:
    return [*CONDITIONS, *(" && ".join(p) for p in combinations(CONDITIONS, 2))]


def feature_counts(labelled: DataFrame) -> DataFrame:
    """Distinct rows of the conditions' truth values with the number of matches and non-matches: at most 2**16 rows,
    however many pairs there are."""
    bits = [evaluator(c).alias(f"c{i}") for i, c in enumerate(CONDITIONS)]
    rows = labelled.select(*bits, "is_match")
    return rows.groupBy(*(f"c{i}" for i in range(len(CONDITIONS)))).agg(F.count_if("is_match").alias("positive"), F.count_if(~F.col("is_match")).alias("negative"))


def support(labelled: DataFrame) -> DataFrame:
    """condition, tp, fp, precision, recall, f1 of all single conditions and pairs, in one pass."""
    names = candidates()
    sums = [f(F.when(evaluator(c), F.lit(1)).otherwise(0) * F.when(F.col("is_match") == want, 1).otherwise(0)).alias(f"{k}{i}") for i, c in enumerate(names) for k, want, f in (("t", True, F.sum), ("f", False, F.sum))]
    one = labelled.agg(F.count_if("is_match").alias("positives"), *sums)
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("condition"), F.coalesce(f"t{i}", F.lit(0)).cast("long").alias("tp"), F.coalesce(f"f{i}", F.lit(0)).cast("long").alias("fp")) for i, c in enumerate(names)))
    rows = one.select("positives", F.explode(rows).alias("r")).select("positives", "r.*")
    rows = rows.withColumns({"precision": F.expr("try_divide(tp, tp + fp)"), "recall": F.expr("try_divide(tp, positives)")})
    return rows.withColumn("f1", F.expr("CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0D END")).drop("positives")


def induce(labelled: DataFrame, mode: str = "performance") -> list[dict]:
    """Up to 30 rules. Each round takes the condition of the highest F1 (ties: the first) among those precise enough,
    and removes the matches it covers. Works on the grouped feature counts, which are bounded."""
    counted = feature_counts(labelled).toPandas()
    bit = {c: counted[f"c{i}"].to_numpy(bool) for i, c in enumerate(CONDITIONS)}
    holds = {c: _holds(c, bit) for c in candidates()}
    left, negative, found = counted["positive"].to_numpy(float).copy(), counted["negative"].to_numpy(float), []
    for turn in range(ROUNDS):
        total = left.sum()
        if total < LEAST:
            break
        best, best_f1 = None, 0.0
        for condition, where in holds.items():
            tp, fp = left[where].sum(), negative[where].sum()
            precision, recall = (tp / (tp + fp), tp / total) if tp + fp else (0.0, 0.0)
            f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
            if tp + fp and precision >= (STRICT if turn < STRICT_ROUNDS else LOOSE) and f1 > best_f1:
                best, best_f1 = {"condition": condition, "precision": precision, "recall": recall, "f1": f1, "true_positives": int(tp), "false_positives": int(fp), "examples_covered": int(tp), "mode": mode}, f1
        if best is None:
            break
        best["confidence"] = "definite" if best["precision"] >= 0.99 else "high" if best["precision"] >= 0.95 else "medium"
        found.append(best)
        left[holds[best["condition"]]] = 0
    return found


def _holds(condition: str, bit: dict):
    """Truth of a condition over the rows of feature counts."""
    if condition in bit:
        return bit[condition]
    a, b = next((x, y) for x, y in combinations(CONDITIONS, 2) if f"{x} && {y}" == condition)
    return (bit[a] & bit[b]) & (not condition.startswith("given_jw >"))


def negative_pairs(records: DataFrame, per_bucket: int = 4, seed: int = 42) -> DataFrame:
    """Pairs of records of different persons, drawn by a hash: a record meets those that fall into its bucket. There
    are as many buckets as it takes to hold ``per_bucket`` records each, so pairs grow with the records, not with their
    square. A sampling operator: it is meant to return a part of all pairs."""
    buckets = max(1, records.count() // per_bucket)
    rows = records.select("record_id", "person_id", F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(buckets)).alias("g"))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.g = y.g AND x.record_id < y.record_id AND x.person_id <> y.person_id"))
    return pairs.select(F.col("x.record_id").alias("left_id"), F.col("y.record_id").alias("right_id"))
