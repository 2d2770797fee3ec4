"""Script detection, tokenizers and simple similarities as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK_CLASS = "[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\uF900-\\uFAFF]"
KANA_CLASS = "[\\u3040-\\u30FF]"
HANGUL_CLASS = "[\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_cjk(c: Column | str) -> Column:
    return col(c).rlike(CJK_CLASS)


def detect_script(c: Column | str) -> Column:
    """cjk, latin, or mixed: both, or neither."""
    cjk, latin = contains_cjk(c), col(c).rlike("[A-Za-z]")
    return F.when(cjk & ~latin, "cjk").when(latin & ~cjk, "latin").otherwise("mixed")


def detect_language(c: Column | str) -> Column:
    """japanese (kana), korean (hangul), chinese (other CJK) or unknown."""
    c = col(c)
    return F.when(c.rlike(KANA_CLASS), "japanese").when(c.rlike(HANGUL_CLASS), "korean").when(contains_cjk(c), "chinese").otherwise("unknown")


def chars(c: Column | str) -> Column:
    """The characters of a string; an empty one has none."""
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "\\s", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), "\\s+"), lambda x: x != "")


def normalise(c: Column | str) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.array_join(words(c), " "))


def cjk_ngrams(c: Column | str, n: int) -> Column:
    """Sliding windows of n characters, white space dropped; a shorter string is its only window, an empty one has none."""
    s = without_space(c)
    size = F.char_length(s)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(s)).otherwise(windows)


def exact(a: Column | str, b: Column | str) -> Column:
    return (normalise(a) == normalise(b)).cast("double")


def ngram_similarity(a: Column | str, b: Column | str, n: int = 2) -> Column:
    """Windows of a (repeats counted) that occur in b, over all windows less those; both empty 1, one empty 0."""
    x, y = cjk_ngrams(a, n), cjk_ngrams(b, n)
    shared = F.size(F.filter(x, lambda g: F.array_contains(y, g)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared))


def mapped(c: Column | str, table: Mapping[str, str]) -> Column:
    """Replace characters one by one, in one native ``translate``."""
    return F.translate(col(c), "".join(table), "".join(table.values())) if table else col(c)


def lookup(c: Column | str, table: Mapping[str, str]) -> Column:
    """The table's value, or null. The table is one literal, fixed and small, folded when the query is planned; a literal
    for each entry would take longer to send to the JVM than the query runs."""
    entries = "\u0001".join(f"{k}\u0002{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(entries), F.lit("\u0001"), F.lit("\u0002")), col(c))


def strip_tone(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[0-9]$", "")


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - levenshtein / longer length, of stroke strings; equal ones 1, a missing one 0."""
    a, b = col(a), col(b)
    return F.when(a == b, 1.0).when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def bigram_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the distinct character pairs of two strings of two characters or more, else 0."""
    x, y = F.array_distinct(cjk_ngrams(a, 2)), F.array_distinct(cjk_ngrams(b, 2))
    both = (F.char_length(col(a)) > 1) & (F.char_length(col(b)) > 1)
    return F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def combine(strategy: str, phonetic: Column, visual: Column, p: float | None = None, v: float | None = None) -> Column:
    """max; weighted (weights p, v); either (thresholds p, v: below both the maximum counts half)."""
    best = F.greatest(phonetic, visual)
    if strategy == "weighted":
        p, v = 0.5 if p is None else p, 0.5 if v is None else v
        return (phonetic * p + visual * v) / (p + v) if p + v else F.lit(0.0)
    if strategy == "either":
        met = (phonetic >= (0.8 if p is None else p)) | (visual >= (0.75 if v is None else v))
        return F.when(met, best).otherwise(best * 0.5)
    return best


def address_similarity(a: Column, b: Column) -> Column:
    """Two Hong Kong addresses (structs). Registry references decide alone if both have one; different districts never
    match; else the weights of the parts that both have: district .1, building .3 (or estate .3), block .15, floor .2,
    flat .25."""

    def part(name: str, weight: float, also: Column = F.lit(True)) -> tuple[Column, Column]:
        there = a[name].isNotNull() & b[name].isNotNull() & also
        return F.when(there & (a[name] == b[name]), weight).otherwise(0.0), F.when(there, weight).otherwise(0.0)

    building = a["building"].isNotNull() & b["building"].isNotNull()
    parts = [part("district", 0.1), part("building", 0.3), part("estate", 0.3, ~building), part("block", 0.15), part("floor", 0.2), part("flat", 0.25)]
    score, weight = (sum((p[i] for p in parts[1:]), parts[0][i]) for i in (0, 1))
    apart = a["district"].isNotNull() & b["district"].isNotNull() & (a["district"] != b["district"])
    refs = a["ogcio_ref"].isNotNull() & b["ogcio_ref"].isNotNull()
    return F.when(refs, (a["ogcio_ref"] == b["ogcio_ref"]).cast("double")).when(apart, 0.0).when(weight > 0, score / weight).otherwise(0.0)


ADDRESS = "flat string, floor string, block string, building string, estate string, street_number string, street string, district string, ogcio_ref string, raw string"
