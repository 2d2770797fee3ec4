import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinloom.functions import names, text, udfs
from kinloom.functions.dictionaries import char_matches_romanisation, from_files, load_romanisations
from kinloom.operators import blocking, induce, matching, nodes, rules, seeds, survivorship
from kinloom.operators.components import connected_components
from kinloom.operators.prepare import prepare
from kinloom.plans import catalog
from kinloom.plans.resolve import resolve
from kinloom.session import shelve
from kinloom.sources import population, records, results

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def decide(spark, dictionaries, a, b, **fields):
    """Decision for two names; fields: phone, email, ... as pairs."""
    rows = [(i, f"R{i}", "crm", n, *(fields.get(f, (None, None))[i] for f in ("phone", "email", "dob", "district"))) for i, n in enumerate((a, b))]
    p = shelve(prepare(spark.createDataFrame(rows, "idx long, record_id string, source string, name string, phone string, email string, dob string, district string"), dictionaries), "p")
    pair = nodes.side(p.where("idx = 0"), "a").crossJoin(nodes.side(p.where("idx = 1"), "b"))
    r = matching.evaluate(pair, dictionaries).first()
    return rules.LEVELS[r["confidence"]], r["rule"]


@pytest.mark.parametrize(
    ("a", "b", "fields", "level", "rule"),
    [
        ("陳大文", "陈大文", {}, "definite", "R2"), ("Dr. Bob Smith", "Dr. Robert Smith", {}, "high", "R3"), ("Chan Tai Man", "CHAN Tai Man", {}, "definite", "R1"),
        ("KWAN Suet Ling", "KWAN Nga Man", {"phone": ("91234567", "91234567")}, "non_match", "no rule"),
        ("CHAN Tai Man", "CHAN Tai Wai", {"phone": ("91234567", "91234567")}, "high", "R3d"),
        ("陳大文", "Chan Siu Ling", {"email": ("a@b.c", "A@b.c")}, "high", "R3e"), ("陳明", "Chan Ming", {}, "medium", "R4"),
        ("Chan", "Chan Tai Man", {}, "non_match", "R9"), ("Chan", "Chan Tai Man", {"dob": ("1990", "1990")}, "review", "R9"),
        ("", "", {}, "definite", "R1"),
    ],
)
def test_decisions(spark, dictionaries, a, b, fields, level, rule):
    found = decide(spark, dictionaries, a, b, **fields)
    assert found[0] == level and found[1].startswith(rule)


def test_phone_match(spark):
    d = spark.createDataFrame([("91234567", "91234568"), ("12344567", "98785670"), ("1234", "1234"), ("", ""), (None, "1")], "a string, b string")
    assert [r[0] for r in d.select(nodes.phone_match(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_rules_from_json():
    with pytest.raises(ValueError):
        rules.parse_condition("nonsense && given_exact")
    assert rules.requirements([{"condition": "!given_exact && phone_match"}]) == {"given_exact", "phone_match"}


def test_json_rules_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    records.write_rules(path, catalog.JSON_RULES, mode="performance")
    assert records.read_rules(path) == catalog.JSON_RULES


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(got.columns)].astype(object).values.tolist()), key=repr)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_resolution_is_consistent(spark, dictionaries):
    r = resolve(population.records(spark, SF), dictionaries)
    assert r.members.groupBy("idx").count().where("count > 1").count() == 0
    assert r.states().count() == r.prepared.count()
    pairs = [tuple(sorted((x["left_id"], x["right_id"]))) for x in r.matches.collect()]
    assert len(pairs) == len(set(pairs)) and all(a != b for a, b in pairs)
    custom = resolve(population.records(spark, SF), dictionaries, [{"condition": "phone_match && family_match", "confidence": "high"}])
    assert {x["rule"].split("_", 1)[-1] for x in custom.matches.select("rule").distinct().collect()} <= {"phone_match && family_match", "match && family_match"}


def test_seeds_do_not_depend_on_partitions(spark, dictionaries):
    p = shelve(prepare(population.records(spark, SF), dictionaries), "p")
    one = {tuple(r) for r in seeds.seed_members(p).collect()}
    two = {tuple(r) for r in seeds.seed_members(p.repartition(7)).collect()}
    assert one == two and one


def test_components(spark):
    chain = [(i, i + 1) for i in range(99)] + [(200, 201), (201, 200), (300, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(100)} == {0} and found[201] == 200 and 300 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    names = connected_components(spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string"))
    assert {tuple(r) for r in names.collect()} == {("x", "x"), ("y", "x"), ("z", "x")}


def test_components_of_whole_tables(spark):
    tables = [(f"SELECT o_orderkey, o_custkey FROM '{SF}/orders.parquet'", 1), (f"SELECT l_orderkey, l_partkey FROM '{SF}/lineitem.parquet'", 2)]
    edges = [(4 * a, 4 * b + kind) for sql, kind in tables for a, b in duckdb.sql(sql).fetchall()]
    above = {n: n for e in edges for n in e}

    def top(n):
        while above[n] != n:
            above[n] = n = above[above[n]]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    want = {n: top(n) for n in above}
    assert {r.node: r.component for r in catalog.QUERIES["linked_components"](spark, SF).collect()} == want
    assert max(map(list(want.values()).count, set(want.values()))) > 64


def test_pairs_of_persons_are_not_broadcast(spark, dictionaries):
    p = shelve(prepare(population.records(spark, SF), dictionaries), "p")
    few = catalog._person_pairs(p).select("a_family", "b_family", "a_phone", "b_phone")
    assert "Broadcast" not in few._jdf.queryExecution().executedPlan().toString()


def test_survivorship(spark):
    rows = [(1, 0, "A", "crm", "ab", None), (1, 1, "B", "billing", "abc", "x"), (1, 2, "C", "crm", "xyz", "y"), (1, 3, "D", "legacy", "", "z")]
    m = spark.createDataFrame(rows, "cluster_id long, position long, record_id string, source string, name string, phone string")
    full = {r.field: r for r in survivorship.golden_records(m, ["name", "phone"], survivorship.MostComplete()).collect()}
    assert (full["name"].value, full["name"].source_record_id) == ("xyz", "C") and full["phone"].value == "z"
    trusted = survivorship.golden_records(m, ["name", "phone"], survivorship.MostTrustedSource(("crm", "billing")))
    by = {r.field: r for r in trusted.collect()}
    assert by["name"].value == "ab" and (by["phone"].value, by["phone"].source_system) == ("x", "billing")
    assert survivorship.as_maps(trusted).first()["id"] == "golden_1"


def test_csv_round_trip(spark, tmp_path):
    r = population.records(spark, SF)
    records.write_records(r, str(tmp_path / "csv"))
    back = records.read_records(spark, str(tmp_path / "csv"))
    assert back.count() == r.count() and records.content_hash(back) == records.content_hash(r.select(*[c for c in back.columns]))
    (tmp_path / "odd.csv").write_text("record_id,source,person_id,name,district,phone\nA,crm,x,CHAN Tai; Bob,,1,2\nB,crm,1\nC,crm,2,n,d\nA,crm,3,again,,\n", encoding="utf-8")
    rows = {(x.record_id, x.person_id): x for x in records.read_records(spark, str(tmp_path / "odd.csv")).collect()}
    assert rows["A", -1].name == "CHAN Tai, Bob" and rows["A", -1].district is None and rows["A", -1].phone == "1,2" and rows["C", 2].phone is None and len(rows) == 3
    truth = {x.record_id: x.person_id for x in records.read_truth(spark, str(tmp_path / "odd.csv")).collect()}
    assert truth == {"A": -1, "C": 2}
    assert records.read_sample(spark, str(tmp_path / "odd.csv"), 1).count() == 1


def test_results_store(spark, dictionaries, tmp_path):
    from kinloom.operators import metrics

    r = population.records(spark, SF)
    found = resolve(r, dictionaries)
    results.write(str(tmp_path), matches=results.numbered(found.matches), clusters=results.membership(found.members, found.clusters, r), pipeline_stats=results.statistics(spark, [("phase1", 1, 2, 3, 0.0), ("phase1", 2, 2, 3, 0.0)]))
    assert results.read(spark, str(tmp_path), "matches").count() == found.matches.count()
    assert results.read(spark, str(tmp_path), "pipeline_stats").count() == 1
    results.export_csv(metrics.with_truth(found.matches, r), str(tmp_path / "export"))
    assert spark.read.option("header", True).csv(str(tmp_path / "export")).count() == found.matches.count()


def test_generator(spark, dictionaries):
    g = population.generate(spark, 500)
    assert g.count() == population.generate(spark, 500).repartition(3).count() > 1000
    assert g.groupBy("record_id").count().where("count > 1").count() == 0


def test_induction_recovers_a_rule(spark):
    rows = [(i % 2 == 0, i % 2 == 0, i % 3 == 0) for i in range(60)]
    d = spark.createDataFrame(rows, "is_match boolean, phone_match boolean, given_exact boolean")
    for c in ("family_exact", "family_st", "family_romanization", "given_st", "given_romanization", "given_partial", "email_match", "dob_match"):
        d = d.withColumn(c, F.lit(c == "family_exact"))
    found = induce.induce(d.withColumn("given_jw", F.lit(0.0)))
    assert found and found[0]["precision"] == 1.0 and "phone_match" in found[0]["condition"] and found[0]["confidence"] == "definite"


def test_rules_are_measured_on_all_pairs_of_a_person(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    truth = {tuple(r) for r in con.execute(catalog.SQL["truth_pairs"]).fetchall()}
    person = dict(con.execute(f"SELECT record_id, person_id FROM ({population.records_sql()})").fetchall())
    found = [tuple(r) for r in catalog._labelled(spark, SF).select("a_record_id", "b_record_id", "is_match").collect()]
    assert {r[:2] for r in found if r[2]} == truth and len(found) == len(set(found))
    apart = [abs(person[a] - person[b]) for a, b, same in found if not same]
    assert min(apart) > 0 and max(apart) > 1
    support = catalog.QUERIES["rule_support"](spark, SF).where("recall > 0").collect()
    assert support and {round(r.tp / r.recall) for r in support} == {len(truth)}


def test_blocking(spark, dictionaries):
    rows = [(0, "A", "crm", "陳大文先生"), (1, "B", "billing", "CHAN Tai Man, Peter"), (2, "C", "english", "Peter Chan")]
    p = shelve(prepare(spark.createDataFrame(rows, "idx long, record_id string, source string, name string"), dictionaries), "p")
    assert blocking.candidate_pairs(blocking.blocks(p, blocking.composite_keys())).count() == 3
    assert blocking.candidate_pairs(blocking.blocks(p, blocking.composite_keys(), most=2)).count() == 0


def made_rows(found):
    """The most rows that a node of a plan made, after it ran."""
    found.collect()
    most, left = 0, [found._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        left += below or [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_blocks_pair_only_records_whose_names_may_match(spark, dictionaries):
    names_ = ("CHAN Tai Man", "CHAN Wing Sze", "CHAN Ka Ho", "CHAN Yuk Fan")
    rows = [(i, f"R{i}", "crm", names_[i % 4]) for i in range(400)]
    p = shelve(prepare(spark.createDataFrame(rows, "idx long, record_id string, source string, name string"), dictionaries), "p")
    none = matching.match_blocks(p, dictionaries, [{"condition": "family_match && given_exact && phone_match", "confidence": "high"}])
    assert none.count() == 0 and made_rows(none) < 5000  # of 79,800 pairs
    assert matching.match_blocks(p, dictionaries).count() == 4 * 100 * 99 // 2


ODD_RULES = [
    {"condition": "family_exact && !phone_match && given_exact && district_match", "confidence": "Definite"}, {"condition": "email_match && !dob_match", "confidence": "review"},
    {"condition": "dob_match && given_jw > 0.85", "confidence": "medium"}, {"condition": "!district_match && given_partial", "confidence": "high"}, {"condition": "email_match", "confidence": "medium"},
]


@pytest.mark.parametrize("json_rules", [None, ODD_RULES, catalog.JSON_RULES, []], ids=["cascade", "odd", "json", "none"])
def test_blocks_agree_with_all_their_pairs(spark, dictionaries, monkeypatch, json_rules):
    import random

    draw = random.Random(7).choice
    names_ = ["陳大文先生", "陈大文", "CHAN Tai Man, Peter", "Dr. Chan Tai", "Peter Chan", "CHAN Tai Wai", "Chan", "", None, "Mr. Bob Chan Jr.", "Robert Chan", "梁志明", "LEUNG Chi Ming", "陳文"]
    # a district may look like the end of a phone, and both keys of a record then are one block
    rows = [(i, f"R{i * 37 % 101:03}", "crm", draw(names_), draw(["91234567", "91234568", "61234567", "", None]), draw(["a@b.c", "A@b.c", None]), draw(["1990", "1991", None]), draw(["ph:4567", "Sha Tin", "sha tin", None])) for i in range(100)]
    p = shelve(prepare(spark.createDataFrame(rows, "idx long, record_id string, source string, name string, phone string, email string, dob string, district string"), dictionaries), "p")
    monkeypatch.setattr(blocking, "PART", 16)
    for most in (None, 30):
        pairs = blocking.candidate_pairs(blocking.blocks(p, blocking.composite_keys(), most)).join(nodes.side(p, "a"), "a_idx").join(nodes.side(p, "b"), "b_idx")
        every = matching.evaluate(pairs, dictionaries, json_rules)
        want = every.where("classification <> 'non_match'").select("a_record_id", "b_record_id", "score", F.lit("stage2"), "rule", "classification").collect()
        assert sorted(map(tuple, matching.match_blocks(p, dictionaries, json_rules, most).collect())) == sorted(map(tuple, want))
        assert bool(want) == (json_rules != [])


def test_a_block_of_any_size_is_matched_whole(spark, dictionaries):
    rows = [(i, f"R{i}", "crm", "CHAN Tai Man", "Sha Tin", f"{i // 2}@b.c" if i < 6 else None) for i in range(blocking.MAX_BLOCK + 1)]
    p = shelve(prepare(spark.createDataFrame(rows, "idx long, record_id string, source string, name string, district string, email string"), dictionaries), "p")
    found = matching.match_blocks(p, dictionaries, [{"condition": "family_match && given_exact && email_match", "confidence": "high"}])
    assert sorted((r.left_id, r.right_id) for r in found.collect()) == [("R0", "R1"), ("R2", "R3"), ("R4", "R5")]


def test_missed_pairs_look_at_no_other_pairs(spark, tmp_path):
    # one surname and one district: a block of 600 records
    spark.range(300).select((F.col("id") * 1520).alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    found = catalog.QUERIES["missed_pairs"](spark, str(tmp_path))
    assert made_rows(found) < 5000  # of 179,700 pairs
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.SQL["missed_pairs"]).fetchall())


def test_sql_functions(spark, dictionaries):
    udfs.register(spark, dictionaries)
    r = spark.sql("SELECT jaro_winkler('martha', 'marhta') AS j, has_cjk('a陳') AS c, compare_exact(' A b', 'a  B') AS e, compare_cjk('陳', '陈', 'max') AS s").first()
    assert round(r.j, 4) == 0.9611 and r.c and r.e == 1.0 and json.loads(r.s)["is_normalization_match"]
    a = spark.createDataFrame([('{"flat":"A","raw":"x"}', '{"flat":"A","raw":"y"}'), ("{", '{"raw":"y"}'), ('{"flat":"A"}', '{"raw":"y"}')], "a string, b string")
    out = [json.loads(x[0]) for x in a.select(udfs.compare_addresses(F.col("a"), F.col("b"))).collect()]
    assert out[0] == {"score": 1.0} and "error" in out[1] and "error" in out[2]


def test_a_job_is_taken_up_again(spark, dictionaries, tmp_path, monkeypatch):
    from kinloom.operators import matching as steps

    people, job, done = population.records(spark, SF), str(tmp_path / "job"), []
    whole = resolve(people, dictionaries)
    run = steps.match_blocks
    monkeypatch.setattr(steps, "match_blocks", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # the last stage breaks; those before it are kept
        resolve(people, dictionaries, job=job)
    monkeypatch.setattr(steps, "match_blocks", run)
    monkeypatch.setattr(seeds, "seed_members", lambda *a: done.append(1))
    again = resolve(people, dictionaries, job=job)
    assert not done and sorted(map(tuple, again.matches.collect())) == sorted(map(tuple, whole.matches.collect()))
    assert sorted(map(tuple, again.members.collect())) == sorted(map(tuple, whole.members.collect()))


def test_dictionary_files(dictionaries, tmp_path):
    files = {"strokes": "木 1234\n李 1234521\nx\n", "simplified": "# traditional, simplified\n龍\t龙竜\n\n", "traditional": "龙\t龍\n", "jyutping": "龍:lung4,lung1\n:x\n虎:\n", "romans": "陳\tChan,CHEN\n"}
    paths = {}
    for name, text_ in files.items():
        paths[name] = str(tmp_path / name)
        (tmp_path / name).write_text(text_, encoding="utf-8")
    known = from_files(dictionaries, **{k: v for k, v in paths.items() if k != "romans"})
    assert known.strokes["木"] == "1234" and known.to_simplified["龍"] == "龙" and known.to_traditional["龙"] == "龍" and known.jyutping["龍"] == ["lung4", "lung1"] and "虎" not in known.jyutping
    romans = load_romanisations(paths["romans"])
    assert romans == {"陳": ["chan", "chen"]} and char_matches_romanisation("陳", "Chan", romans) and not char_matches_romanisation("陳", "Wong", romans)


def test_sql_functions_agree_with_columns(spark, dictionaries):
    udfs.register(spark, dictionaries)
    raw = ["陳大文先生", "CHAN Tai Man, Peter", "Dr. Peter Q. Chan Jr.", "小明", "司徒 美玲", "山田たろうさん", "김철수씨", "", "  ", "Chan", "Mr", "阿", "Au-Yeung Wing", "Szeto, Bob. X", "王先生", "先生", "Mary-Jane O'Neil PhD MBA", "陳 David"]
    rows = spark.createDataFrame([(r,) for r in raw], "name string")
    found = names.with_components(rows).withColumn("j", F.expr("parse_name(name)")).collect()
    for r in found:
        got = json.loads(r.j)
        assert (got["language"].lower(), got["family"], got["given"], got["title"], got["suffix"], got["prefix"], got["honorific"]) == (r.language, r.family, list(r.given), r.title, r.suffix, r.prefix, r.honorific), r.name
    pairs = rows.crossJoin(rows.withColumnRenamed("name", "other"))
    for r in pairs.select("name", "other", text.ngram_similarity("name", "other").alias("n"), F.expr("compare_cjk_ngram(name, other)").alias("s")).collect():
        assert abs(r.n - r.s) < 1e-12, (r.name, r.other)
    one = json.loads(spark.sql("SELECT compare_names('Dr. Bob Smith', 'Robert Smith', true, 0.02) AS j").first().j)
    assert one["left"]["title"] == "Dr" and one["result"]["synonym_applied"] and one["result"]["core_score"] == 0.99
    two = json.loads(spark.sql("""SELECT compare_addresses('{"raw":"x","flat":"A","floor":"1"}', '{"raw":"y","flat":"A","floor":"2"}') AS j""").first().j)
    assert abs(two["score"] - 0.25 / 0.45) < 1e-9 and two["a"]["flat"] == "A" and two["b"]["district"] is None
    assert "error" in json.loads(spark.sql("SELECT compare_addresses('{', '{}') AS j").first().j)
    nulls = spark.sql("SELECT parse_name(NULL) AS a, compare_names(NULL, 'x', true, 0.0) AS b, compare_components(NULL, '{}', true, 0.0) AS c, compare_cjk_ngram('a', NULL) AS d, compare_addresses(NULL, NULL) AS e, compare_cjk(NULL, 'x', 'max') AS f").first()
    assert all(x is None for x in nulls)
    parsed = spark.createDataFrame([("Dr Bob Smith", "Robert Smith"), ("Ann Lee", "Ann Marie Lee")], "a string, b string")
    score = udfs.parsed_name_score(dictionaries)(names.parse_name("a"), names.parse_name("b"))
    assert [round(x[0], 3) for x in parsed.select(score).collect()][0] == 1.0


def test_labels_of_the_cascade(spark):
    base = dict.fromkeys(["family_exact", "family_st", "family_romanization", "given_exact", "given_st", "given_synonym", "given_romanization", "given_partial", "given_missing", "phone_match", "email_match", "any_corroboration", "title_match", "suffix_match"], False)
    base |= {"given_jw": 0.0, "given_bigram_jaccard": 0.0, "given_char_lcs": 0.0}
    cases = [
        (dict(family_exact=True, given_exact=True), "R1: family exact + given exact"), (dict(family_st=True, given_st=True), "R2: family S↔T + given S↔T"),
        (dict(family_exact=True, given_synonym=True), "R3: family exact + given synonym"), (dict(family_st=True, phone_match=True, given_jw=0.9), "R3d: family + phone + given signal"),
        (dict(family_exact=True, email_match=True), "R3e: family match + email match"), (dict(family_exact=True, given_bigram_jaccard=1.0), "R3b: family match + CJK given bigram exact (J=1.00)"),
        (dict(family_exact=True, given_char_lcs=0.625, any_corroboration=True), "R3c: family match + CJK given LCS 62% + corroborated"),
        (dict(family_exact=True, given_romanization=True, any_corroboration=True), "R4: family match + given romanization + corroborated"),
        (dict(family_exact=True, given_romanization=True), "R4: family match + given romanization (uncorroborated)"),
        (dict(family_romanization=True, given_exact=True), "R5: family romanization + given exact (uncorroborated)"),
        (dict(family_exact=True, given_bigram_jaccard=0.625), "R6b: family match + given bigram J 0.62 (uncorroborated)"),
        (dict(family_exact=True, given_partial=True), "R8: family match + given partial (uncorroborated)"),
        (dict(family_exact=True, given_missing=True), "R9: family match + given missing (uncorroborated — insufficient)"),
        (dict(family_exact=True, given_missing=True, any_corroboration=True), "R9: family match + given missing + corroborated"),
        (dict(family_exact=True, title_match=True, any_corroboration=True), "R10: family match + title/suffix + corroborated"),
        (dict(family_exact=True, suffix_match=True), "R10: family match + title/suffix only (insufficient)"), ({}, "no rule matched"),
    ]
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean'}" for k, v in base.items())
    rows = spark.createDataFrame([tuple((base | given).values()) for given, _ in cases], schema).coalesce(1)
    assert [r.rule for r in rules.decide(rows).collect()] == [label for _, label in cases]


def test_command_line(spark, tmp_path):
    from kinloom.__main__ import main

    csv, out = str(tmp_path / "people"), str(tmp_path / "out")
    main(["generate", "120", csv])
    main(["resolve", csv, out])
    assert results.read(spark, out, "matches").count() > 0 and results.read(spark, out, "pipeline_stats").where("phase = 'total'").count() == 1
    main(["match", csv, str(tmp_path / "pairs"), "--rules", str(rules_file(tmp_path))])
    assert set(spark.read.parquet(str(tmp_path / "pairs")).columns) == set(matching.RESULT)
    main(["induce", csv, str(tmp_path / "induced.json"), "--negatives", "200"])
    assert all(r["confidence"] in rules.LEVELS for r in records.read_rules(str(tmp_path / "induced.json")))


def rules_file(folder):
    path = folder / "rules.json"
    records.write_rules(str(path), catalog.JSON_RULES)
    return path


def test_arrivals(spark, dictionaries, tmp_path):
    from kinloom.streaming.arrivals import assign_arrivals

    people = population.records(spark, SF)
    known = resolve(people.where("source <> 'english'"), dictionaries)
    people.where("source = 'english'").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = assign_arrivals(stream, known.clusters, known.prepared, dictionaries, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    late = shelve(prepare(people.where("source = 'english'"), dictionaries), "late")
    want = matching.assign(late, known.clusters, known.prepared.unionByName(late), dictionaries)
    assert got.count() == late.count()
    assert {tuple(r) for r in got.where("cluster_id IS NOT NULL").select("record_id", "cluster_id").collect()} == {tuple(r) for r in want.select("a_record_id", "cluster_id").collect()}
