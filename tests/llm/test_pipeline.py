"""The pipeline, stage by stage, against plain Python."""

import pytest

import corpus_pipeline
from collections import Counter

from pyspark.sql import functions as F

from kinloom.llm import language, queries, secrets

SF = "/root/testdata/sf0.001"
test_operators = pytest.importorskip("test_operators")


def test_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = rows.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language.train(rows)
    want = {r.doc_id: r.text for r in rows.collect()}
    sure = {r.doc_id for r in language.predict(rows, model, ["doc_id"]).collect() if r.lang_pred != "und" and r.score >= language.MIN_SCORE}
    want = {i: t for i, t in want.items() if i in sure}
    groups = test_operators.brute_components(list(want), list(want.values()))
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    hits = {i: test_operators.brute_hits(t, bench) for i, t in want.items()}
    want = {i: t for i, t in want.items() if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])}
    words = secrets.automaton()
    masked = {i: secrets.masked(t, secrets.scan(t, words), "[secret]") for i, t in want.items()}
    expected = [None, None, want, masked]
    for (name, stage), known in zip(corpus_pipeline.STAGES[:-1], expected):
        rows = corpus_pipeline.shelve(stage(spark, rows, SF), name)
        assert rows.columns == columns
        if known is not None:
            assert {r.doc_id: r.text for r in rows.collect()} == known, name
    assert all(len(r.text) == r.n_chars for r in rows.collect() if r.text != want[r.doc_id])
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert {r.doc_id for r in packed} == set(masked)
    test_operators.check_packed(packed)


def test_run_on_nothing(spark, tmp_path):
    rows, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ("score", "lang_pred", "_rejected", "_one", "_spans", "id", "row_id", "key", "_key", "_row", "_text", "component_id", "n", "spans", "hits", "piece", "sequence_id", "turns")


def test_odd_documents(spark, tmp_path):
    """Names that clash, nulls, repeated ids and rows: every operator and every stage, against the same rows bare."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()
    kept = [tuple(r) for r in rows] + [tuple(r) for r in rows[:6]]  # repeated rows
    kept += [(rows[0].doc_id, rows[8].text + " and one more", "en", "s", 0), (None, rows[9].text, "en", "s", 0), (None, rows[10].text + " x", None, None, None), (None, None, None, None, None), (777, "", "en", None, 0), (778, "\n \t", None, "s", 3)]
    bare = spark.createDataFrame(kept, spark.read.parquet(f"{SF}/documents.parquet").schema)
    odd = bare.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, rows_in in (("bare", bare), ("odd", odd)):
        rows_in.write.parquet(str(tmp_path / name / "documents.parquet"))
        for t in ("benchmark", "labels", "conversations"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / name / f"{t}.parquet"))
    assert bench.count()
    for name, query in queries.QUERIES.items():
        got = [Counter(map(str, query(spark, str(tmp_path / t)).drop("sequence_id", "offset").collect())) for t in ("bare", "odd")]
        assert got[0] == got[1] and (name == "op4_chat_format" or len({r for r in got[0]}) > 3), name
        if name not in ("op4_chat_format", "op8_packing"):
            assert sum(got[0].values()) == len(kept), name
    results = []
    for t in ("bare", "odd"):
        docs, seen = spark.read.parquet(str(tmp_path / t / "documents.parquet")), []
        for stage, function in corpus_pipeline.STAGES[:-1]:
            before, docs = docs.columns, corpus_pipeline.shelve(function(spark, docs, str(tmp_path / t)), stage)
            assert docs.columns == before, stage
            seen.append(Counter((r.doc_id, r.text) for r in docs.collect()))
            if t == "odd":
                assert all(r[c] == f"own {c}" for r in docs.collect() for c in CLASHING), stage
        results.append(seen)
    assert results[0] == results[1]
    language_kept, unique_kept = results[0][0], results[0][1]
    assert max(unique_kept.values()) == 1 and sum(unique_kept.values()) < sum(language_kept.values())
    near = test_operators.brute_components(list(range(len(language_kept))), [t for _, t in language_kept])
    assert len({c for _, c in near.values()}) == sum(unique_kept.values())


def test_without_a_label_only_texts_without_letters_go(spark):
    docs = spark.createDataFrame([(1, "abc def", None), (2, "12 34", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()} == {1, 4}
