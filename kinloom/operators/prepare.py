"""Records with their parsed names and all keys that grouping and blocking need. Column expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import names, tables, text
from kinloom.functions.dictionaries import Dictionaries, strip_tone

FIELDS = ("phone", "email", "dob", "district")


def readings(dictionaries: Dictionaries) -> dict[str, str]:
    return {c: strip_tone(r[0]).lower() for c, r in dictionaries.jyutping.items()}


def syllables(word: Column, to_traditional: Mapping[str, str], jyutping: Mapping[str, str]) -> Column:
    """Toneless Jyutping of the CJK characters of a word; those without a reading are left out."""
    spelled = F.transform(text.chars(text.mapped(word, to_traditional)), lambda c: text.lookup(c, jyutping))
    return F.array_compact(spelled)


def surname_key(family: Column, to_traditional: Mapping[str, str], jyutping: Mapping[str, str]) -> Column:
    """Upper-case Jyutping of the surname where it is known, else its first character (upper case for a surname of
    Hong Kong, lower case for another Latin one); empty without a family name."""
    first, family_name = F.substring(family, 1, 1), F.lower(family)
    by_char = F.upper(text.lookup(text.mapped(first, to_traditional), jyutping))
    by_name = F.upper(text.lookup(family_name, {r: jyutping[c] for r, c in tables.HK_SURNAMES.items() if c in jyutping}))
    key = F.when(text.contains_cjk(first), F.coalesce(by_char, first)).when(names.is_hk_surname(family), F.coalesce(by_name, F.upper(first))).otherwise(F.lower(first))
    return F.coalesce(key, F.lit(""))


def richness(language: Column, given: Column, source: Column) -> Column:
    """How much a record tells."""
    score = sum((F.when(F.col(f).isNotNull(), w).otherwise(0) for f, w in zip(FIELDS, (20, 20, 25, 5))), F.lit(0))
    trust = F.when(source == "crm", 10).when(source == "billing", 8).when(source == "legacy", 3).otherwise(1)
    return (score + F.when(language == "chinese", 15).otherwise(0) + F.when(F.size(given) > 0, 10).otherwise(0) + trust).cast("long")


def prepare(records: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """``records`` (idx, record_id, source, name and any of phone, email, dob, district; person_id may be there) with
    parsed parts, the four name keys, the surname key and the richness. Empty strings count as absent."""
    for f in FIELDS:
        value = F.nullif(F.col(f).cast("string"), F.lit("")) if f in records.columns else F.lit(None).cast("string")
        records = records.withColumn(f, value)
    keep = [c for c in ("idx", "record_id", "source", "person_id", "name", *FIELDS) if c in records.columns]
    rows = names.with_components(records.select(*keep))
    simple, full, jyutping = dictionaries.to_simplified, dictionaries.to_traditional, readings(dictionaries)
    family, given, none = F.col("family"), F.col("given"), F.array().cast("array<string>")
    by_name = {r: jyutping.get(c, "") for r, c in tables.HK_SURNAMES.items()}
    rows = rows.withColumns({
        "_raw": F.coalesce("name", F.lit("")), "_joined": F.concat(F.coalesce(family, F.lit("")), F.array_join(given, "")),
        "_spelled": text.lookup(F.lower(family), by_name), "_cjk": text.contains_cjk(F.substring(family, 1, 1)),
    })
    # the romanised name: Jyutping of characters, lower-case Latin words
    known = F.when(F.col("_spelled").isNull(), F.array(F.lower(family))).otherwise(F.filter(F.array("_spelled"), lambda x: x != ""))
    first = F.when(family.isNull(), none).when(F.col("_cjk"), syllables(family, full, jyutping)).otherwise(known)
    rest = F.flatten(F.transform(given, lambda g: F.when(text.contains_cjk(g), syllables(g, full, jyutping)).when(g != "", F.array(F.lower(g))).otherwise(none)))
    rows = rows.withColumns({
        "key_exact": text.normalise("_raw"), "key_s_t": text.normalise(text.mapped("_raw", simple)),
        "key_stripped": text.normalise(text.mapped("_joined", simple)), "key_romanized": F.array_join(F.concat(first, rest), " "),
        "surname_key": surname_key(family, full, jyutping), "richness": richness(F.col("language"), given, F.col("source")),
    })
    return rows.drop("_raw", "_joined", "_spelled", "_cjk")


__all__ = ["prepare", "readings", "richness", "surname_key", "syllables", "tables"]
