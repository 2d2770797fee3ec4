from pyspark.sql import functions as F

from kinloom.functions import names, tables, text


def parts(spark, *raw):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, name string")
    return {r["name"]: r for r in names.with_components(rows).collect()}


def test_components_of_latin_names(spark):
    p = parts(spark, "Dr. Robert J. Smith Jr.", "CHAN Tai Man, Peter", "Peter Chan", "Wong Wai-Keung", "Mr.", "", "Mr Dr Ann Lee MBA PhD")
    assert (p["Dr. Robert J. Smith Jr."].title, p["Dr. Robert J. Smith Jr."].family, p["Dr. Robert J. Smith Jr."].given, p["Dr. Robert J. Smith Jr."].suffix) == ("Dr", "Smith", ["Robert", "J"], "Jr")
    assert (p["CHAN Tai Man, Peter"].family, p["CHAN Tai Man, Peter"].given) == ("CHAN", ["Tai", "Man", "Peter"])
    assert (p["Peter Chan"].family, p["Peter Chan"].given) == ("Chan", ["Peter"])
    assert (p["Wong Wai-Keung"].family, p["Wong Wai-Keung"].given) == ("Wong", ["Wai", "Keung"])
    assert (p["Mr."].title, p["Mr."].family, p["Mr."].given) == ("Mr", None, [])
    assert (p[""].family, p[""].given, p[""].language) == (None, [], "latin")
    assert (p["Mr Dr Ann Lee MBA PhD"].title, p["Mr Dr Ann Lee MBA PhD"].suffix) == ("Mr", "PhD")


def test_components_of_cjk_names(spark):
    p = parts(spark, "歐陽大文", "欧阳明", "陳先生", "阿明", "小", "小陳", "田中さん", "김씨", "김철수", "陳", " 陳大文 ")
    get = lambda n: (p[n].language, p[n].family, p[n].given, p[n].prefix, p[n].honorific)
    assert get("歐陽大文") == ("chinese", "歐陽", ["大文"], None, None)
    assert get("欧阳明") == ("chinese", "欧阳", ["明"], None, None)
    assert get("陳先生") == ("chinese", "陳", [], None, "先生")
    assert get("阿明") == ("chinese", None, ["明"], "阿", None)
    assert get("小") == ("chinese", "小", [], None, None)
    assert get("小陳") == ("chinese", None, ["陳"], "小", None)
    assert get("田中さん") == ("japanese", None, ["田", "中"], None, "さん")
    assert get("김씨") == ("korean", None, ["김"], None, "씨")
    assert get("김철수") == ("korean", None, ["김", "철", "수"], None, None)
    assert get("陳") == ("chinese", "陳", [], None, None)
    assert get(" 陳大文 ") == ("chinese", "陳", ["大文"], None, None)


def test_parse_name_and_cjk_name(spark):
    d = spark.createDataFrame([("Dr. Robert J. Smith III",), ("阿明",), ("山田先生",), ("김씨",), ("小",)], "n string")
    rows = {r.n: r for r in d.select("n", names.parse_name("n").alias("p"), names.parse_cjk_name("n").alias("k")).collect()}
    p = rows["Dr. Robert J. Smith III"].p
    assert (p.stripped, p.salutations_removed, p.suffixes_removed, p.tokens) == ("Robert J Smith", ["Dr"], ["III"], ["robert", "j", "smith"])
    assert rows["阿明"].k.stripped == "明" and rows["阿明"].k.prefixes_removed == ["阿"]
    assert rows["山田先生"].k.stripped == "山田" and rows["김씨"].k.stripped == "김" and rows["小"].k.stripped == "小"


def test_scripts_and_ngrams(spark):
    d = spark.createDataFrame([("陳大文",), ("Chan Tai Man",), ("Chan 陳",), ("",), ("123",), ("陳",)], "n string")
    rows = {r.n: r for r in d.select("n", text.detect_script("n").alias("s"), text.cjk_ngrams("n", 2).alias("g"), text.cjk_ngrams("n", 3).alias("t")).collect()}
    assert [rows[n].s for n in ("陳大文", "Chan Tai Man", "Chan 陳", "", "123")] == ["cjk", "latin", "mixed", "mixed", "mixed"]
    assert rows["陳大文"].g == ["陳大", "大文"] and rows["陳"].g == ["陳"] and rows[""].g == [] and rows["陳大文"].t == ["陳大文"]


def test_synonyms_and_surnames(spark):
    d = spark.createDataFrame([("Bob", "Robert"), ("Rob", "Bob"), ("Robert", "William"), ("x", "X")], "a string, b string")
    assert [r[0] for r in d.select(names.are_synonyms("a", "b").alias("s")).collect()] == [True, True, False, True]
    t = spark.createDataFrame([("Chan",), ("AuYeung",), ("Au-Yeung",), ("Smith",)], "t string")
    assert [tuple(r) for r in t.select(names.is_hk_surname("t"), names.surname_char("t")).collect()] == [(True, "陳"), (True, None), (True, None), (False, None)]
    assert len(tables.HK_SURNAMES) == 88 and len(tables.SYNONYM_GROUPS) == 61 and len(tables.JYUTPING_FINAL_XY) == 54


def test_similarities(spark):
    d = spark.createDataFrame([("陳大文", "陳大明"), ("", ""), ("a", ""), ("aaa", "aa")], "a string, b string")
    assert [round(r[0], 4) for r in d.select(text.ngram_similarity("a", "b").alias("s")).collect()] == [round(1 / 3, 4), 1.0, 0.0, 2.0]
    s = spark.createDataFrame([("5212511234", "521251112"), ("1", "1"), (None, "1")], "a string, b string")
    assert [round(r[0], 4) for r in s.select(F.coalesce(text.edit_similarity("a", "b"), F.lit(-1.0)).alias("s")).collect()][:2] == [0.7, 1.0]


def test_address(spark):
    cols = ["flat", "floor", "block", "building", "estate", "district", "ogcio_ref"]
    schema = ", ".join(f"a_{c} string" for c in cols) + ", " + ", ".join(f"b_{c} string" for c in cols)
    full, other = ("A", "1", "2", "T", None, "D", None), ("A", "2", "2", "T", None, "D", None)
    rows = [full + full, full + other, full + (None,) * 5 + ("E", None), (None,) * 6 + ("r",) + (None,) * 6 + ("r",), (None,) * 14]
    d = spark.createDataFrame(rows, schema)
    side = lambda p: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in cols))
    assert [round(r[0], 4) for r in d.select(text.address_similarity(side("a"), side("b")).alias("s")).collect()] == [1.0, 0.8, 0.0, 1.0, 0.0]
