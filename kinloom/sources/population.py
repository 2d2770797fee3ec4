"""A deterministic population of person records, derived by arithmetic from the keys of ``customer``.

The text of the query is plain SQL that Spark and DuckDB read alike, so the same rows exist on both sides. Each person
has a CRM record and a billing record; every second one a legacy record; some a record under an English name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import tables

#: romanised, traditional, simplified
SURNAMES = "Chan 陳 陈|Leung 梁 梁|Cheung 張 张|Lau 劉 刘|Li 李 李|Cheng 鄭 郑|Yeung 楊 杨|Chow 周 周|Wong 黃 黄|Ho 何 何|Lam 林 林|Yip 葉 叶|Siu 蕭 萧|Tse 謝 谢|Ma 馬 马|Szeto 司徒 司徒"
GIVEN = "Chi Ming/志明/志明|Tai Man/大文/大文|Ka Ho/家豪/家豪|Mei Ling/美玲/美玲|Wing Sze/詠詩/咏诗|Kin Wai/健偉/健伟|Ming/明/明|Chun Kit/俊傑/俊杰|Wai Man/慧敏/慧敏|Yuk Fan/玉芬/玉芬|Hin/軒/轩|Tin Lok/天樂/天乐"
ENGLISH = "Peter Bob Robert William Bill Susan Jenny Michael Mike Kate David Grace".split()
#: Simplified form of each traditional character above.
PAIRS = {t: s for row in SURNAMES.split("|") for t, s in zip(*row.split()[1:]) if t != s} | {t: s for row in GIVEN.split("|") for t, s in zip(*row.split("/")[1:]) if t != s}


def _pick(expr: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {cases} END"


def records_sql(table: str = "customer") -> str:
    """idx, record_id, source, person_id, name, district, phone. Absent values are null."""
    surname, given = [r.split() for r in SURNAMES.split("|")], [r.split("/") for r in GIVEN.split("|")]
    a, b = "floor(k / 16)", "floor(k / 5)"
    a, b = f"CAST({a} AS BIGINT)", f"CAST({b} AS BIGINT)"
    return f"""
    WITH keys AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM {table}),
    person AS (SELECT k, {_pick('k * k + 3 * k', [s[0] for s in surname])} AS sur, {_pick('k * k + 3 * k', [s[1] for s in surname])} AS sur_t,
        {_pick('k * k + 3 * k', [s[2] for s in surname])} AS sur_s, {_pick(a, [g[0] for g in given])} AS giv, {_pick(a, [g[1] for g in given])} AS giv_t,
        {_pick(a, [g[2] for g in given])} AS giv_s, {_pick('7 * k + 1', ENGLISH)} AS eng, k % 25 < 16 AS has_eng,
        {_pick(b, tables.DISTRICTS)} AS dist,
        concat(CASE WHEN k % 2 = 0 THEN '9' ELSE '6' END, lpad(CAST((k * 48611) % 10000000 AS STRING), 7, '0')) AS ph FROM keys),
    variants AS (
        SELECT 4 * k AS idx, concat('CRM-', lpad(CAST(k AS STRING), 9, '0')) AS record_id, 'crm' AS source, k AS person_id, concat(sur_t, giv_t, '先生') AS name, dist AS district, CASE WHEN k % 5 <> 0 THEN ph END AS phone FROM person
        UNION ALL SELECT 4 * k + 1, concat('BILL-', lpad(CAST(k AS STRING), 9, '0')), 'billing', k, concat(upper(sur), ' ', giv, CASE WHEN has_eng THEN concat(', ', eng) ELSE '' END), CASE WHEN k % 10 < 7 THEN dist END, ph FROM person
        UNION ALL SELECT 4 * k + 2, concat('LEGACY-', lpad(CAST(k AS STRING), 9, '0')), 'legacy', k, concat(sur_s, giv_s), NULL, CASE WHEN k % 7 < 3 THEN ph END FROM person WHERE k % 2 = 1
        UNION ALL SELECT 4 * k + 3, concat('ENG-', lpad(CAST(k AS STRING), 9, '0')), 'english', k, concat(eng, ' ', sur), NULL, CASE WHEN k % 11 < 8 THEN ph END FROM person WHERE has_eng AND k % 3 = 0)
    SELECT idx, record_id, source, person_id, name, district, phone FROM variants"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(records_sql("{customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def generate(spark: SparkSession, persons: int, seed: int = 42) -> DataFrame:
    """A population of any size by hashed picks: the same columns, with weights by rank for surnames.

    A pick is a hash of the person's number and a salt, so every executor makes its own part and reruns agree.
    """
    surname, given = [r.split() for r in SURNAMES.split("|")], [r.split("/") for r in GIVEN.split("|")]

    def draw(salt: str, n: int):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(salt), F.lit(seed)), F.lit(n))

    def pick(salt: str, values: list, n: int | None = None):
        return F.element_at(F.array(*map(F.lit, values)), (draw(salt, n or len(values)) + 1).cast("int"))

    weighted = [s for i, s in enumerate(surname) for _ in range(max(1, 16 // (i + 1)))]
    p = spark.range(persons).select(
        "id", *(pick("surname", [s[i] for s in weighted]).alias(x) for i, x in enumerate(("sur", "sur_t", "sur_s"))),
        *(pick("given", [g[i] for g in given]).alias(x) for i, x in enumerate(("giv", "giv_t", "giv_s"))), pick("english", ENGLISH).alias("eng"),
        (draw("has", 100) < 64).alias("has_eng"), pick("district", tables.DISTRICTS).alias("dist"),
        F.concat(pick("prefix", ["9", "6"]), F.lpad(draw("phone", 10_000_000).cast("string"), 7, "0")).alias("ph"),
        *((draw(f"rate{i}", 100) < rate).alias(f"r{i}") for i, rate in enumerate((80, 70, 50, 40, 30, 70))),
    )
    rid = lambda prefix: F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 7, "0"))
    when = lambda flag, value: F.when(F.col(flag), F.col(value))
    row = lambda keep, i, prefix, source, name, district, phone: F.when(keep, F.struct((F.col("id") * 4 + i).alias("idx"), rid(prefix).alias("record_id"), F.lit(source).alias("source"), F.col("id").alias("person_id"), name.alias("name"), district.alias("district"), phone.alias("phone")))
    none = F.lit(None).cast("string")
    alias = F.when(F.col("has_eng"), F.concat(F.lit(", "), F.col("eng"))).otherwise(F.lit(""))
    rows = F.array(
        row(F.lit(True), 0, "CRM-", "crm", F.concat("sur_t", "giv_t", F.lit("先生")), F.col("dist"), when("r0", "ph")),
        row(F.lit(True), 1, "BILL-", "billing", F.concat(F.upper("sur"), F.lit(" "), "giv", alias), when("r1", "dist"), F.col("ph")),
        row(F.col("r2"), 2, "LEGACY-", "legacy", F.concat("sur_s", "giv_s"), none, when("r3", "ph")),
        row(F.col("has_eng") & F.col("r4"), 3, "ENG-", "english", F.concat_ws(" ", "eng", "sur"), none, when("r5", "ph")),
    )
    return p.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")
