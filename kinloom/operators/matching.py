"""Matching of members, of leftover records with clusters, and of the remainder in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.dictionaries import Dictionaries
from kinloom.operators import blocking, nodes, rules
from kinloom.session import shelve

RESULT = ["left_id", "right_id", "score", "phase", "rule", "classification"]


def evaluate(pairs: DataFrame, dictionaries: Dictionaries, json_rules: list[dict] | None = None) -> DataFrame:
    """Pairs (a_*, b_*) with all features and a decision."""
    return rules.decide(nodes.all_nodes(pairs, dictionaries), json_rules)


def _result(pairs: DataFrame, phase: str, prefix: str = "") -> DataFrame:
    return pairs.select(F.col("a_record_id").alias("left_id"), F.col("b_record_id").alias("right_id"), "score", F.lit(phase).alias("phase"), (F.concat(F.lit(prefix), "rule") if prefix else F.col("rule")).alias("rule"), "classification")


def validate_members(members: DataFrame, clusters: DataFrame, prepared: DataFrame, dictionaries: Dictionaries, json_rules=None) -> DataFrame:
    """Each member of a phone-corroborated cluster against its attractor; matches of high confidence."""
    star = members.join(clusters.where("phone_corroborated").select("cluster_id", "attractor_idx"), "cluster_id").where("idx <> attractor_idx")
    pairs = star.select(F.col("attractor_idx").alias("a_idx"), F.col("idx").alias("b_idx"))
    pairs = pairs.join(nodes.side(prepared, "a"), "a_idx").join(nodes.side(prepared, "b"), "b_idx")
    return _result(evaluate(pairs, dictionaries, json_rules).where(F.col("confidence") >= rules.HIGH), "phase2a", "phase2a_")


def cluster_candidates(left: DataFrame, clusters: DataFrame, prepared: DataFrame) -> DataFrame:
    """(a_idx, b_idx, cluster_id, richness): leftover records and attractors under the same surname key whose phones do
    not contradict each other.

    Two present phones must be equal, so those pairs join on the phone as well; only pairs that lack a phone join on
    the surname key alone.
    """
    r = left.where("surname_key <> ''").select(F.col("idx").alias("a_idx"), "surname_key", "phone")
    c = clusters.join(prepared.select(F.col("idx").alias("attractor_idx"), "phone"), "attractor_idx")
    c = c.where("surname_key <> ''").select(F.col("attractor_idx").alias("b_idx"), "cluster_id", "richness", "surname_key", F.col("phone").alias("b_phone"))
    keep = ["a_idx", "b_idx", "cluster_id", "richness"]
    both = r.join(c, (r.surname_key == c.surname_key) & (r.phone == c.b_phone)).select(*keep)
    no_left = r.where("phone IS NULL").join(c, "surname_key").select(*keep)
    no_right = r.where("phone IS NOT NULL").join(c.where("b_phone IS NULL"), "surname_key").select(*keep)
    return both.unionAll(no_left).unionAll(no_right)


def assign(left: DataFrame, clusters: DataFrame, prepared: DataFrame, dictionaries: Dictionaries, json_rules=None) -> DataFrame:
    """The best cluster of each leftover record: highest confidence, then richest, then smallest id; high or better.
    One row: idx, cluster_id and the match."""
    pairs = cluster_candidates(left, clusters, prepared)
    pairs = pairs.join(nodes.side(prepared, "a"), "a_idx").join(nodes.side(prepared, "b"), "b_idx")
    good = evaluate(pairs, dictionaries, json_rules).where(F.col("confidence") >= rules.HIGH)
    rank = F.struct("confidence", "richness", (-F.col("cluster_id")).alias("_back"))
    best = good.groupBy("a_idx", "a_record_id").agg(F.max_by(F.struct("cluster_id", "b_record_id", "score", "rule", "classification"), rank).alias("m"))
    return best.select(F.col("a_idx").alias("idx"), "a_record_id", "m.*")


def assigned_matches(assigned: DataFrame) -> DataFrame:
    return _result(assigned, "phase2b", "phase2_")


def match_blocks(left: DataFrame, dictionaries: Dictionaries, json_rules=None, most: int | None = None) -> DataFrame:
    """All pairs of the remainder that share a block; possible and certain matches. Only a caller that gives ``most`` leaves
    out the blocks of more records.

    Names are compared once for each two forms that meet in any block. Forms that no rule can call a match, whatever phones
    and the like say, are dropped there; the others are judged for each way in which these may agree, and records are paired
    only where one of these ways is a match, and kept where it is theirs. What is said of two forms is numbered, so the
    records of a block meet with numbers, and neither names nor labels are shuffled with them.
    """
    keys, facts = blocking.composite_keys(), [f.removesuffix("_match") for f in rules.facts(json_rules)]
    rows = blocking.blocks(left, keys, most)
    rows = rows.withColumn("_blocks", keys if most is None else F.collect_set("block").over(Window.partitionBy("idx")))
    units = shelve(blocking.form_units(rows, nodes.FORM, {f: nodes.fact_key(f) for f in facts}), "units")
    forms = shelve(units.select("form").distinct().withColumn("form_id", F.monotonically_increasing_id()), "forms")
    met = blocking.forms_met(units.join(forms.hint("merge"), "form"), facts)
    for s in "ab":
        met = met.join(forms.select(F.col("form_id").alias(f"{s}_form_id"), *(F.col(f"form.{c}").alias(f"{s}_{c}") for c in nodes.FORM)).hint("merge"), f"{s}_form_id")
    may = {f"{f}_match": F.col(f"may_{f}") if f in facts else F.lit(False) for f in nodes.FACTS}
    may["any_corroboration"] = may["phone_match"] | may["email_match"] | may["dob_match"]
    found = nodes.form_nodes(met, dictionaries).where(rules.reachable(json_rules, may))
    judged = rules.decide(nodes.fact_cases(found, facts), json_rules).where(F.col("confidence") >= rules.MEDIUM)
    ways = F.sort_array(F.collect_list(F.struct("case", "rule", "score", "classification")))
    judged = shelve(judged.groupBy("a_form_id", "b_form_id").agg(ways.alias("ways")), "judged")
    said = shelve(judged.select("ways").distinct().withColumn("said_id", F.monotonically_increasing_id()), "said")
    about = F.map_from_entries(F.collect_list(F.struct("b_form_id", "said_id"))).alias("about")
    about = judged.join(said, "ways").groupBy(F.col("a_form_id").alias("form_id")).agg(about)
    forms = shelve(forms.hint("merge").join(about, "form_id", "left"), "forms")
    of_case = F.transform(F.sequence(F.lit(0), F.lit((1 << len(facts)) - 1)), lambda i: F.filter("ways", lambda w: w["case"] == i))
    # labels are few, however many the records are
    pairs = blocking.record_pairs(units.join(forms.hint("merge"), "form"), F.broadcast(said.select("said_id", of_case.alias("ways"))), facts)
    # one way or none, found once and not for each of its columns
    return _result(pairs.select("a_record_id", "b_record_id", F.inline(F.get("ways", nodes.fact_case(facts)))), "stage2")


def match_pairs(pairs: DataFrame, prepared: DataFrame, dictionaries: Dictionaries, json_rules=None) -> DataFrame:
    """What ``match_blocks`` says of ``pairs`` (a_idx, b_idx) that share a block."""
    for s in "ab":
        pairs = pairs.join(nodes.side(prepared, s).hint("merge"), f"{s}_idx")
    return _result(evaluate(pairs, dictionaries, json_rules).where(F.col("confidence") >= rules.MEDIUM), "stage2")
