"""Features of a pair of prepared records, one column each, so that what no rule needs is pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import udfs
from kinloom.functions.dictionaries import Dictionaries

#: What a side of a pair carries into the comparison.
SIDE = ("record_id", "idx", "source", "name", "family", "given", "title", "suffix", "phone", "email", "dob", "district")
#: The form of a name, and what corroborates it: all that a decision rests on.
FORM, FACTS = ("family", "given", "title", "suffix"), ("phone", "email", "dob", "district")


def side(prepared: DataFrame, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return prepared.select(*(F.col(c).alias(f"{prefix}_{c}") for c in (*SIDE, *extra)))


def _same(name: str, fold: bool = True) -> Column:
    a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
    equal = F.lower(a) == F.lower(b) if fold else a == b
    return F.coalesce((a != "") & equal, F.lit(False))


def phone_match(a: Column, b: Column) -> Column:
    """Equal, or as long and alike in the first seven digits; lengths count bytes."""
    near = (F.octet_length(a) == F.octet_length(b)) & (F.octet_length(a) >= 7) & (F.substring(a, 1, 7) == F.substring(b, 1, 7))
    return F.coalesce((a != "") & (b != "") & ((a == b) | near), F.lit(False))


def corroborated(pairs: DataFrame) -> DataFrame:
    """The features of phones, emails, dates of birth and districts."""
    found = pairs.withColumns({
        "phone_match": phone_match(F.col("a_phone"), F.col("b_phone")), "email_match": _same("email"), "dob_match": _same("dob", fold=False), "district_match": _same("district"),
    })
    return found.withColumn("any_corroboration", F.col("phone_match") | F.col("email_match") | F.col("dob_match"))


def native_nodes(pairs: DataFrame) -> DataFrame:
    """The features that are plain expressions: corroboration, titles, exact names."""
    fa, fb, ga, gb = F.col("a_family"), F.col("b_family"), F.col("a_given"), F.col("b_given")
    lower = lambda g: F.transform(g, lambda x: F.lower(x))
    found = corroborated(pairs.withColumns({"title_match": _same("title"), "suffix_match": _same("suffix")}))
    return found.withColumns({"family_exact": F.lower(fa).eqNullSafe(F.lower(fb)), "given_exact": F.coalesce(lower(ga) == lower(gb), F.lit(False))})


def fact_key(fact: str) -> Column:
    """A text that is equal in two records if and only if the fact (phone, ...) matches; null if it matches none."""
    value = F.nullif(F.col(fact), F.lit(""))
    if fact == "phone":  # a short phone is shorter than any of these keys
        return F.when(F.octet_length(value) >= 7, F.concat(F.octet_length(value), F.lit(":"), F.substring(value, 1, 7))).otherwise(value)
    return value if fact == "dob" else F.lower(value)


def fact_case(facts: list[str]) -> Column:
    """The facts whose keys a pair has in common, as a number: the first counts 1, the second 2, the third 4."""
    return sum((F.when(F.col(f"a_{f}") == F.col(f"b_{f}"), 1 << i).otherwise(0) for i, f in enumerate(facts)), F.lit(0))


def fact_cases(met: DataFrame, facts: list[str]) -> DataFrame:
    """Each two forms (``blocking.forms_met``) once for every way in which ``facts`` may match between their records, with
    the number of ``fact_case``; other facts do not match."""
    for f in FACTS:
        may = F.when(F.col(f"may_{f}"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))) if f in facts else None
        met = met.withColumn(f"{f}_match", F.lit(False) if may is None else F.explode(may))
    case = sum((F.when(F.col(f"{f}_match"), 1 << i).otherwise(0) for i, f in enumerate(facts)), F.lit(0))
    return met.withColumns({"any_corroboration": F.col("phone_match") | F.col("email_match") | F.col("dob_match"), "case": case})


def form_nodes(pairs: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """The features that rest on the forms of two names alone, each pair compared once although a filter may follow."""
    nodes = udfs.name_nodes(dictionaries, once=True)(F.col("a_family"), F.col("a_given"), F.col("b_family"), F.col("b_given"))
    found = pairs.withColumns({"title_match": _same("title"), "suffix_match": _same("suffix"), "_n": nodes})
    return found.select("*", "_n.*").drop("_n")


def all_nodes(pairs: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """All 21 features. Name features come from one Arrow UDF, the others are native."""
    found = native_nodes(pairs).drop("family_exact", "given_exact")
    nodes = udfs.name_nodes(dictionaries)(F.col("a_family"), F.col("a_given"), F.col("b_family"), F.col("b_given"))
    return found.withColumn("_n", nodes).select("*", "_n.*").drop("_n")
