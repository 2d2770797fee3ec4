"""Name parsing as Column expressions: no Python runs for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import tables, text

COMPONENTS = "struct<raw:string,language:string,title:string,family:string,given:array<string>,suffix:string,prefix:string,honorific:string>"


def _none() -> Column:
    return F.array().cast("array<string>")


def _in(token: Column, values: list[str]) -> Column:
    return F.lower(token).isin(*values)


def _leading(tokens: Column, values: list[str]) -> Column:
    """How many tokens at the start are among the values."""
    flags = F.transform(tokens, lambda t: _in(t, values))
    first_other = F.array_position(flags, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(tokens)).cast("int")


def _trailing(tokens: Column, values: list[str]) -> Column:
    return _leading(F.reverse(tokens), values)


def _slice(tokens: Column, start: Column, count: Column) -> Column:
    return F.slice(tokens, start, F.greatest(count, F.lit(0)))


def _stripped(tokens: Column) -> tuple[Column, Column, Column]:
    """Leading titles, the rest, trailing suffixes."""
    n = F.size(tokens)
    head = _leading(tokens, tables.SALUTATIONS)
    rest = _slice(tokens, head + 1, n - head)
    tail = _trailing(rest, tables.SUFFIXES)
    return _slice(tokens, F.lit(1), head), _slice(rest, F.lit(1), F.size(rest) - tail), _slice(rest, F.size(rest) - tail + 1, tail)


def parse_name(raw: Column | str) -> Column:
    """Latin name without its titles and suffixes: struct of raw, salutations_removed, suffixes_removed (last first),
    stripped, normalized, tokens."""
    raw = text.col(raw)
    titles, rest, suffixes = _stripped(text.words(F.translate(raw, ".,", "  ")))
    stripped = F.array_join(rest, " ")
    return F.struct(
        raw.alias("raw"), titles.alias("salutations_removed"), F.reverse(suffixes).alias("suffixes_removed"), stripped.alias("stripped"),
        F.lower(stripped).alias("normalized"), F.transform(rest, F.lower).alias("tokens"),
    )


def _ending(s: Column, values: list[str]) -> Column:
    """The first of the values that ends the string and is not all of it, or null."""
    return F.coalesce(*(F.when(s.endswith(v) & (F.char_length(s) > len(v)), F.lit(v)) for v in values))


def _cut(s: Column, tail: Column) -> Column:
    return F.when(tail.isNull(), s).otherwise(F.substring(s, F.lit(1), F.char_length(s) - F.char_length(tail)))


def _cjk_parts(raw: Column, language: Column) -> tuple[Column, Column, Column]:
    """Prefix, honorific and what is between them."""
    trimmed = F.trim(F.regexp_replace(raw, "^\\s+|\\s+$", ""))
    first = F.substring(trimmed, 1, 1)
    prefix = F.when((language == "chinese") & first.isin(*tables.CHINESE_PREFIXES) & (F.char_length(trimmed) > 1), first)
    rest = F.when(prefix.isNull(), trimmed).otherwise(F.substring(trimmed, F.lit(2), F.char_length(trimmed)))
    own = F.when(language == "japanese", _ending(rest, tables.JAPANESE_HONORIFICS)).when(language == "korean", _ending(rest, tables.KOREAN_HONORIFICS))
    honorific = F.coalesce(_ending(rest, tables.SHARED_HONORIFICS), own)
    return prefix, honorific, _cut(rest, honorific)


def parse_cjk_name(raw: Column | str) -> Column:
    """CJK name without prefix and honorific: struct of raw, language, prefixes_removed, suffixes_removed, stripped,
    chars. A Chinese name loses a shared honorific, a Japanese or Korean one an honorific of its language."""
    raw = text.col(raw)
    language = text.detect_language(raw)
    trimmed = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    prefix, honorific, rest = _cjk_parts(raw, language)
    other = F.when(language == "japanese", _ending(trimmed, tables.JAPANESE_HONORIFICS)).when(language == "korean", _ending(trimmed, tables.KOREAN_HONORIFICS))
    honorific = F.when(language == "chinese", honorific).otherwise(other)
    stripped = F.when(language == "chinese", rest).otherwise(_cut(trimmed, other))
    listed = lambda x: F.when(x.isNull(), _none()).otherwise(F.array(x))
    return F.struct(
        raw.alias("raw"), language.alias("language"), listed(prefix).alias("prefixes_removed"), listed(honorific).alias("suffixes_removed"),
        stripped.alias("stripped"), text.chars(text.without_space(stripped)).alias("chars"),
    )


def compound_surname(s: Column | str) -> Column:
    """The compound surname that a string begins with, or null."""
    s = text.col(s)
    return F.coalesce(*(F.when(s.startswith(c), F.lit(c)) for c in tables.COMPOUND_SURNAMES))


def is_hk_surname(token: Column | str) -> Column:
    low = F.lower(text.col(token))
    compound = dict.fromkeys(sorted({r.lower().replace("-", "") for r in tables.COMPOUND_SURNAMES.values()}), "1")
    known = text.lookup(low, tables.HK_SURNAMES).isNotNull() | text.lookup(F.replace(low, F.lit("-"), F.lit("")), compound).isNotNull()
    return F.when(low.isNotNull(), known)


def surname_char(token: Column | str) -> Column:
    """The character of a romanised single surname, or null."""
    return text.lookup(F.lower(text.col(token)), tables.HK_SURNAMES)


def with_components(rows: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with the typed parts of a name of any script: language, title, family, given, suffix, prefix, honorific.

    A name with a comma is a main part and an alias, whose words follow the given names. A first word that is a Hong
    Kong surname is the family name, else the last word is. A Chinese name is a surname (perhaps compound) and one
    given name; a Japanese or Korean name is given as its characters.

    The steps are columns of their own, so that each expression is planned and computed once.
    """
    c, none = F.col, F.lit(None).cast("string")
    raw = F.coalesce(c(name), F.lit(""))
    comma = F.instr(raw, ",")
    rows = rows.withColumns({
        "_language": text.detect_language(raw), "_trimmed": F.regexp_replace(raw, "^\\s+|\\s+$", ""),
        "_main": text.words(F.translate(F.when(comma > 0, F.substring(raw, F.lit(1), comma - 1)).otherwise(raw), ".-", "  ")),
        "_alias": text.words(F.translate(F.when(comma > 0, F.substring(raw, comma + 1, F.char_length(raw))).otherwise(F.lit("")), ".", " ")),
    })
    # Latin: titles, rest, suffixes
    rows = rows.withColumn("_head", _leading(c("_main"), tables.SALUTATIONS))
    rows = rows.withColumn("_body", _slice(c("_main"), c("_head") + 1, F.size("_main") - c("_head")))
    rows = rows.withColumn("_tail", _trailing(c("_body"), tables.SUFFIXES))
    rows = rows.withColumn("_words", _slice(c("_body"), F.lit(1), F.size("_body") - c("_tail")))
    rows = rows.withColumn("_first", (F.size("_words") == 1) | F.coalesce(is_hk_surname(F.get(c("_words"), F.lit(0))), F.lit(False)))
    # CJK: prefix, honorific, surname, rest
    start = F.substring("_trimmed", 1, 1)
    chinese = c("_language") == "chinese"
    rows = rows.withColumn("_prefix", F.when(chinese & start.isin(*tables.CHINESE_PREFIXES) & (F.char_length("_trimmed") > 1), start))
    rows = rows.withColumn("_rest", F.when(c("_prefix").isNull(), c("_trimmed")).otherwise(F.expr("substring(_trimmed, 2)")))
    own = F.when(c("_language") == "japanese", _ending(c("_rest"), tables.JAPANESE_HONORIFICS)).when(c("_language") == "korean", _ending(c("_rest"), tables.KOREAN_HONORIFICS))
    rows = rows.withColumn("_honorific", F.coalesce(_ending(c("_rest"), tables.SHARED_HONORIFICS), own))
    rows = rows.withColumn("_cut", _cut(c("_rest"), c("_honorific")))
    rows = rows.withColumns({"_name": text.without_space(c("_cut")), "_compound": compound_surname(c("_cut"))})
    rows = rows.withColumn("_surname", F.coalesce("_compound", F.substring("_name", 1, 1)))
    rows = rows.withColumn("_given", F.when(c("_prefix").isNotNull(), c("_name")).otherwise(F.expr("substring(_name, char_length(_surname) + 1)")))
    # the parts
    latin, n = c("_language") == "unknown", F.size("_words")
    family = F.when(latin, F.when(c("_first"), F.get(c("_words"), F.lit(0))).otherwise(F.try_element_at("_words", F.lit(-1)))).when(chinese & c("_prefix").isNull() & (c("_name") != ""), c("_surname"))
    names_left = F.when(n < 2, _none()).when(c("_first"), _slice(c("_words"), F.lit(2), n - 1)).otherwise(_slice(c("_words"), F.lit(1), n - 1))
    given = F.when(latin, F.concat(names_left, c("_alias"))).when(~chinese | (c("_name") == ""), text.chars("_name")).when(c("_given") == "", _none()).otherwise(F.array("_given"))
    rows = rows.withColumns({
        "language": F.when(latin, "latin").otherwise(c("_language")),
        "title": F.when(latin & (c("_head") > 0), F.get(c("_main"), F.lit(0))), "family": family, "given": given,
        "suffix": F.when(latin & (c("_tail") > 0), F.try_element_at("_body", F.lit(-1))),
        "prefix": F.when(latin, none).otherwise(c("_prefix")), "honorific": F.when(latin, none).otherwise(c("_honorific")),
    })
    return rows.drop("_language", "_trimmed", "_main", "_alias", "_head", "_body", "_tail", "_words", "_first", "_prefix", "_rest", "_honorific", "_cut", "_name", "_compound", "_surname", "_given")


def synonym_groups(token: Column | str) -> Column:
    """Numbers of the synonym groups that hold a given name."""
    groups: dict[str, list[int]] = {}
    for i, group in enumerate(tables.SYNONYM_GROUPS):
        for name in group:
            groups.setdefault(name, []).append(i)
    found = text.lookup(F.lower(text.col(token)), {name: ",".join(map(str, ids)) for name, ids in groups.items()})
    return F.coalesce(F.split(found, ",").cast("array<int>"), F.array().cast("array<int>"))


def are_synonyms(a: Column | str, b: Column | str) -> Column:
    """Equal but for case, or in one group."""
    return (F.lower(text.col(a)) == F.lower(text.col(b))) | F.arrays_overlap(synonym_groups(a), synonym_groups(b))
