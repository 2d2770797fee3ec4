"""Arrow UDFs over the scalar kernels, and the functions that SQL can call by name.

Each worker keeps the results of the pairs it has seen, up to a bound; names repeat a lot.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions import kernels, names, scalars, text
from kinloom.functions.dictionaries import Dictionaries

KEPT = 200_000
NODES = "struct<family_exact:boolean,family_st:boolean,family_romanization:boolean,family_jw:double,family_missing:boolean,given_exact:boolean,given_synonym:boolean,given_st:boolean,given_romanization:boolean,given_jw:double,given_missing:boolean,given_partial:boolean,given_char_lcs:double,given_bigram_jaccard:double>"
SIGNALS = "struct<phonetic:double,visual:double,is_normalization_match:boolean,combined:double,explanation:string>"
PAIR = "struct<component:string,left_value:string,right_value:string,score:double,method:string,left_normalized:string,right_normalized:string>"
NAME_MATCH = f"struct<core_score:double,title_boost:double,suffix_boost:double,synonym_applied:boolean,combined:double,components:array<{PAIR}>,explanation:string>"


def pairwise(function: Callable, kind: T.DataType) -> Callable[[Column, Column], Column]:
    """A column of ``function(a, b)`` for two string columns; null where either is null."""
    state: dict[str, Callable] = {}
    number = isinstance(kind, T.DoubleType)

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if "f" not in state:  # made in the worker: a cache does not travel
            state["f"] = lru_cache(KEPT)(function)
        return pd.Series([None if x is None or y is None else state["f"](x, y) for x, y in zip(a, b)], dtype=float if number else object)

    return run


jaro_winkler = pairwise(lambda a, b: kernels.jaro_winkler(a, b), T.DoubleType())
jaro_winkler_plain = pairwise(lambda a, b: kernels.jaro_winkler(kernels.plain(a), kernels.plain(b)), T.DoubleType())
lcs = pairwise(lambda a, b: float(kernels.lcs_length(a, b)), T.DoubleType())
romanisation = pairwise(lambda a, b: kernels.romanisation_similarity(a, b), T.DoubleType())


def name_nodes(dictionaries: Dictionaries, once: bool = False) -> Callable[..., Column]:
    """Struct of the family and given-name features of (family, given, family, given). With ``once`` Spark does not copy
    it into a filter that reads it."""

    def make() -> Callable:
        comparer = kernels.Comparer(dictionaries)
        return lru_cache(KEPT)(lambda fa, ga, fb, gb: comparer.family_nodes(fa, fb) | comparer.given_nodes(list(ga), list(gb)))

    state: dict[str, Callable] = {}

    @F.pandas_udf(NODES)
    def run(key: pd.Series, fa: pd.Series, ga: pd.Series, fb: pd.Series, gb: pd.Series) -> pd.DataFrame:
        if "f" not in state:
            state["f"] = make()
        some = lambda g: () if g is None else tuple(g)
        codes, _ = pd.factorize(key)  # equal pairs of names are compared once in a batch
        _, first = np.unique(codes, return_index=True)
        rows = [state["f"](w if isinstance(w, str) else None, some(x), y if isinstance(y, str) else None, some(z)) for w, x, y, z in zip(*(c.iloc[first] for c in (fa, ga, fb, gb)))]
        return pd.DataFrame(rows, columns=_NODE_NAMES).take(codes).reset_index(drop=True)

    called = run.asNondeterministic() if once else run

    def column(fa: Column, ga: Column, fb: Column, gb: Column) -> Column:
        return called(F.to_json(F.struct(fa.alias("a"), ga.alias("b"), fb.alias("c"), gb.alias("d"))), fa, ga, fb, gb)

    return column


_NODE_NAMES = [part.split(":")[0] for part in NODES[len("struct<") : -1].split(",")]
_SIGNAL_NAMES = [part.split(":")[0] for part in SIGNALS[len("struct<") : -1].split(",")]


def signals(dictionaries: Dictionaries, strategy: str = "max", p: float | None = None, v: float | None = None) -> Callable[[Column, Column], Column]:
    """Struct of phonetic, visual and combined similarity of two strings of any script."""
    comparer = kernels.Comparer(dictionaries)

    @F.pandas_udf(SIGNALS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.as_dict(comparer.signals(x or "", y or "", strategy, p, v)) for x, y in zip(a, b)], columns=_SIGNAL_NAMES)

    return run


def name_match(dictionaries: Dictionaries, use_synonyms: bool = True, penalty: float = 0.02) -> Callable[[Column, Column], Column]:
    """JSON of the component-level comparison of two names given as JSON of their parts."""
    state: dict[str, Callable] = {}

    def make() -> Callable:
        comparer = kernels.Comparer(dictionaries)
        return lru_cache(KEPT)(lambda a, b: json.dumps(comparer.names(json.loads(a), json.loads(b), use_synonyms, penalty), ensure_ascii=False))

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if "f" not in state:
            state["f"] = make()
        return pd.Series([None if x is None or y is None else state["f"](x, y) for x, y in zip(a, b)], dtype=object)

    return run


PARTS = ("family", "given", "title", "suffix", "prefix", "honorific")


def compare_names(rows: DataFrame, dictionaries: Dictionaries, a: str, b: str, out: str, use_synonyms: bool = True, penalty: float = 0.02) -> DataFrame:
    """``rows`` with a struct of scores and components of two raw names; parsing is native, scoring is not."""
    keep = rows.columns
    for c in (a, b):
        rows = names.with_components(rows, c).withColumn(f"_{c}_parts", F.to_json(F.struct(*PARTS))).drop("language", *PARTS)
    found = name_match(dictionaries, use_synonyms, penalty)(F.col(f"_{a}_parts"), F.col(f"_{b}_parts"))
    return rows.withColumn(out, F.from_json(found, NAME_MATCH)).select(*keep, out)


def compare_addresses(a: Column, b: Column) -> Column:
    """JSON with the score of two addresses given as JSON; with an error where one cannot be read."""
    x, y = (F.from_json(c, text.ADDRESS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}) for c in (a, b))
    bad = x.isNull() | y.isNull() | x["_bad"].isNotNull() | y["_bad"].isNotNull() | x["raw"].isNull() | y["raw"].isNull()
    good = F.to_json(F.struct(text.address_similarity(x, y).alias("score")))
    return F.when(bad, F.to_json(F.struct(F.lit("not an address").alias("error")))).otherwise(good)


def _rowwise(function: Callable, kind: T.DataType, n: int):
    """A SQL function of ``n`` columns; null where any is null."""
    number = isinstance(kind, T.DoubleType)

    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else function(*row) for row in zip(*columns)], dtype=float if number else object)

    # Arrow UDFs are told apart by their signature
    wrapped = {1: lambda a: apply(a), 2: lambda a, b: apply(a, b), 3: lambda a, b, c: apply(a, b, c), 4: lambda a, b, c, d: apply(a, b, c, d)}[n]
    wrapped.__annotations__ = dict.fromkeys("abcd"[:n], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(wrapped, kind)


def parsed_name_score(dictionaries: Dictionaries, use_synonyms: bool = True) -> Callable[[Column, Column], Column]:
    """Score of two parsed Latin names (``names.parse_name``): token by token, synonyms count 1 if asked."""
    comparer = kernels.Comparer(dictionaries)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else comparer.parsed_names(list(x), list(y), use_synonyms) for x, y in zip(a, b)], dtype=float)

    return lambda a, b: run(a["tokens"], b["tokens"])


def register(spark: SparkSession, dictionaries: Dictionaries) -> list[str]:
    """Make the scalar functions callable from SQL; returns their names. A null argument gives null."""
    comparer, text_, number = kernels.Comparer(dictionaries), T.StringType(), T.DoubleType()
    dump = lambda value: json.dumps(value, ensure_ascii=False)
    functions = {
        "compare_cjk": _rowwise(lambda a, b, strategy: dump(kernels.as_dict(comparer.signals(a, b, strategy))), text_, 3),
        "compare_cjk_ngram": _rowwise(scalars.ngram_similarity, number, 2),
        "parse_name": _rowwise(scalars.parse_name, text_, 1),
        "compare_names": _rowwise(lambda a, b, use, penalty: scalars.compare_names(comparer, a, b, bool(use), float(penalty)), text_, 4),
        "compare_components": _rowwise(lambda a, b, use, penalty: dump(comparer.names(json.loads(a), json.loads(b), bool(use), float(penalty))), text_, 4),
        "compare_addresses": _rowwise(scalars.compare_addresses, text_, 2),
        "jaro_winkler": jaro_winkler, "compare_jaro_winkler": jaro_winkler_plain, "lcs_length": lcs,
    }
    for name, function in functions.items():
        spark.udf.register(name, function)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION compare_exact(a STRING, b STRING) RETURNS DOUBLE RETURN CAST(lower(array_join(filter(split(a, '\\\\s+'), x -> x <> ''), ' ')) = lower(array_join(filter(split(b, '\\\\s+'), x -> x <> ''), ' ')) AS DOUBLE)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION has_cjk(s STRING) RETURNS BOOLEAN RETURN s RLIKE '[\\\\u4E00-\\\\u9FFF\\\\u3400-\\\\u4DBF\\\\uF900-\\\\uFAFF]'")
    return [*functions, "compare_exact", "has_cjk"]
