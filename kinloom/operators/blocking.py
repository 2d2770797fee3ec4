"""Blocking keys and candidate pairs as equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BLOCK = 5000
#: A block of more records is paired in parts, the square root of its size over this; any number gives the same pairs.
PART = 1024
#: A blocking key: an array of keys of a record.
BlockingKey = Callable[[], Column]


def first_char_key(field: str = "name") -> Column:
    first = F.lower(F.substring(F.col(field), 1, 1))
    return F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>"))


def phonetic_surname_key(stripped: Column, script: Column, family: Column, by_char: Column, by_name: Column) -> Column:
    """Key of a whole name: the reading of a CJK name's first character after its prefix and honorific, else of the
    romanised surname; else the character, or the first letter."""
    first = F.substring(stripped, 1, 1)
    cjk = F.when(first != "", F.coalesce(by_char, first))
    latin = F.coalesce(by_name, F.lower(F.substring(family, 1, 1)))
    key = F.when(script == "cjk", cjk).otherwise(latin)
    return F.filter(F.array(key), lambda k: k.isNotNull() & (k != ""))


def composite_keys() -> Column:
    """Keys of the remainder: surname and district, surname and the end of the phone, or the surname alone if a record
    has neither. No surname, no key."""
    surname, district, phone = F.col("surname_key"), F.col("district"), F.col("phone")
    tail = F.when(F.octet_length(phone) >= 4, F.right(phone, F.lit(4)))
    with_district = F.when(district != "", F.concat(surname, F.lit("|"), F.lower(district)))
    with_phone = F.concat(surname, F.lit("|ph:"), tail)
    bare = F.when(with_district.isNull() & with_phone.isNull(), surname)
    keys = F.array_compact(F.array(with_district, with_phone, bare))
    return F.when(surname == "", F.array().cast("array<string>")).otherwise(keys)


def blocks(records: DataFrame, keys: Column, most: int | None = MAX_BLOCK) -> DataFrame:
    """Rows (block, and all columns) of the blocks of two records or more, and of ``most`` at most if given.

    Sizes are counted with a map-side sum and joined back, so a very common key meets in no single task.
    """
    rows = records.withColumn("block", F.explode(keys))
    sizes = rows.groupBy("block").agg(F.count("*").alias("block_size")).where("block_size >= 2")
    sizes = sizes if most is None else sizes.where(F.col("block_size") <= most)
    return rows.join(sizes, "block")


def candidate_pairs(rows: DataFrame, distinct: bool = True) -> DataFrame:
    """(block, a_idx, b_idx), a before b. A pair that shares several blocks stands once, under its first block, unless
    ``distinct`` is off.

    Each row carries all blocks of its record (a few), so a pair is kept where its first common block is, and the pairs
    themselves are never shuffled.
    """
    ids = rows.select("block", "idx").distinct()
    if not distinct:
        a, b = ids.withColumnRenamed("idx", "a_idx"), ids.withColumnRenamed("idx", "b_idx")
        return a.join(b, "block").where("a_idx < b_idx").select("a_idx", "b_idx", "block")
    ids = ids.withColumn("blocks", F.collect_list("block").over(Window.partitionBy("idx")))
    a, b = ids.toDF("block", "a_idx", "a_blocks"), ids.toDF("block", "b_idx", "b_blocks")
    first = F.array_min(F.array_intersect("a_blocks", "b_blocks"))
    return a.join(b, "block").where((F.col("a_idx") < F.col("b_idx")) & (first == F.col("block"))).select("a_idx", "b_idx", "block")


def form_units(rows: DataFrame, form: tuple[str, ...], facts: dict[str, Column]) -> DataFrame:
    """The records of a block that have one form (equal values of ``form``), as members: block, parts, part, form, members,
    their lowest and highest idx, and whether any of them has a fact, as has_*. ``rows`` have the blocks of their record as
    ``_blocks``.

    Records of one form are kept together, so what rests on the forms is found once and not for each pair of records. The
    records of a large block are dealt out in parts.
    """
    rows = rows.withColumn("parts", F.ceil(F.sqrt(F.col("block_size") / PART)))
    member = F.struct("idx", F.filter("_blocks", lambda x: x < F.col("block")).alias("earlier"), "record_id", *(k.alias(f) for f, k in facts.items()))
    rows = rows.select("block", "parts", F.pmod(F.xxhash64("idx"), "parts").alias("part"), F.struct(*form).alias("form"), member.alias("member"))
    has = [F.bool_or(F.col(f"member.{f}").isNotNull()).alias(f"has_{f}") for f in facts]
    # a set, as both keys of a record may be one block
    return rows.groupBy("block", "parts", "part", "form").agg(F.collect_set("member").alias("members"), F.min("member.idx").alias("low"), F.max("member.idx").alias("high"), *has)


def _meeting(units: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Each two of ``units`` in a block whose members are not all in the wrong order, with their columns as a_* and b_*.

    Each part of a block meets all its parts, each two in a group of their own, so no task gets all pairs of a large block.
    """
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    left = units.select("block", F.col("part").alias("i"), every.alias("j"), "low", *(F.col(c).alias(f"a_{c}") for c in a))
    right = units.select("block", every.alias("i"), F.col("part").alias("j"), "high", *(F.col(c).alias(f"b_{c}") for c in b))
    return left.hint("merge").join(right, ["block", "i", "j"]).where("low < high").drop("block", "i", "j", "low", "high")


def forms_met(units: DataFrame, facts: list[str]) -> DataFrame:
    """(a_form_id, b_form_id) of any two forms that meet in a block, a before b, and whether records of both that meet may
    have a fact in common, as may_*."""
    has = [f"has_{f}" for f in facts]
    whole = units.groupBy("block", "parts", "form_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.bool_or(c).alias(c) for c in has))
    met = _meeting(whole.withColumn("part", F.pmod(F.xxhash64("form_id"), "parts")), ["form_id", *has], ["form_id", *has])
    return met.groupBy("a_form_id", "b_form_id").agg(F.count("*").alias("times"), *(F.bool_or(F.col(f"a_has_{f}") & F.col(f"b_has_{f}")).alias(f"may_{f}") for f in facts))


def record_pairs(units: DataFrame, said: DataFrame, facts: list[str]) -> DataFrame:
    """Pairs of records, a before b, of forms of which something is said; a pair that shares several blocks stands once, in
    the first. ``units`` have for their form a map ``about`` from other forms to the ``said_id`` of what is said of both."""
    met = _meeting(units, ["about", "members"], ["form_id", "members"])
    met = met.withColumn("said_id", F.try_element_at("a_about", F.col("b_form_id"))).where("said_id IS NOT NULL").drop("a_about", "b_form_id")
    pairs = met.join(said, "said_id").drop("said_id")
    for s in "ab":
        rest = [c for c in pairs.columns if c != f"{s}_members"]
        pairs = pairs.select(*rest, F.inline(f"{s}_members")).withColumnsRenamed({c: f"{s}_{c}" for c in ("idx", "earlier", "record_id", *facts)})
    return pairs.where((F.col("a_idx") < F.col("b_idx")) & ~F.arrays_overlap("a_earlier", "b_earlier"))


def in_common_block(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a_idx, b_idx) that share a block."""
    of = rows.groupBy("idx").agg(F.collect_set("block").alias("blocks"))
    for s in "ab":
        pairs = pairs.join(of.select(F.col("idx").alias(f"{s}_idx"), F.col("blocks").alias(f"{s}_blocks")).hint("merge"), f"{s}_idx")
    return pairs.where(F.arrays_overlap("a_blocks", "b_blocks")).drop("a_blocks", "b_blocks")


def block_statistics(rows: DataFrame, most: int = MAX_BLOCK) -> DataFrame:
    """Blocks of two or more, the largest, those above ``most``, and pairs in the others."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).where("n >= 2")
    fits = F.col("n") <= most
    pairs = F.sum(F.when(fits, F.expr("n * (n - 1) div 2")).otherwise(0))
    return sizes.agg(F.count_if(fits).alias("blocks"), F.max("n").alias("largest"), F.count_if(~fits).alias("skipped"), pairs.alias("pairs"))
