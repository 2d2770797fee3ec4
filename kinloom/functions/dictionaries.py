"""Character dictionaries: read from text files, or derived by rule from ICU, which ships with Spark."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from kinloom.functions import tables

HAN = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)]


@dataclass(frozen=True)
class Dictionaries:
    """All that name comparison looks up; small enough (some thousand characters) to travel in a closure."""

    to_simplified: dict[str, str] = field(default_factory=dict)
    to_traditional: dict[str, str] = field(default_factory=dict)
    pinyin: dict[str, str] = field(default_factory=dict)
    jyutping: dict[str, list[str]] = field(default_factory=lambda: {c: [r] for c, r in tables.JYUTPING.items()})
    strokes: dict[str, str] = field(default_factory=lambda: dict(tables.STROKES))

    def toneless(self, char: str) -> str | None:
        """Primary Jyutping reading without its tone."""
        found = self.jyutping.get(char)
        return strip_tone(found[0]) if found else None


def strip_tone(reading: str) -> str:
    return reading[:-1] if reading[-1:] in tuple("0123456789") else reading


def _transliterate(spark: SparkSession, rule: str, chars: list[str]) -> list[str]:
    """Each character by an ICU rule; one call for all, a line for each."""
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(rule)
    return icu.transliterate("\n".join(chars)).split("\n")


_CACHE: dict[str, Dictionaries] = {}


def from_icu(spark: SparkSession) -> Dictionaries:
    """Simplified and traditional forms and Mandarin readings of all Han characters, with the tables' Jyutping."""
    if "icu" not in _CACHE:
        chars = [chr(c) for a, b in HAN for c in range(a, b + 1)]
        simple = {c: s for c, s in zip(chars, _transliterate(spark, "Traditional-Simplified", chars)) if s != c and len(s) == 1}
        full = {c: s for c, s in zip(chars, _transliterate(spark, "Simplified-Traditional", chars)) if s != c and len(s) == 1}
        plain = lambda s: "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x))
        pinyin = {c: plain(s).strip().lower() for c, s in zip(chars, _transliterate(spark, "Han-Latin", chars)) if s != c}
        _CACHE["icu"] = Dictionaries(simple, full, pinyin)
    return _CACHE["icu"]


def _lines(path: str):
    with open(path, encoding="utf-8") as file:
        yield from (line.rstrip("\n") for line in file)


def load_strokes(path: str) -> dict[str, str]:
    """Lines ``CHAR STROKES``."""
    parts = (line.split() for line in _lines(path))
    return {p[0]: p[1] for p in parts if len(p) >= 2}


def load_variants(path: str) -> dict[str, str]:
    """Lines ``CHAR<tab>CHAR...``; the first character of each of the first two columns counts; # begins a comment."""
    rows = (line.split("\t") for line in _lines(path) if line.strip() and not line.startswith("#"))
    return {r[0][0]: r[1][0] for r in rows if len(r) > 1 and r[0] and r[1]}


def load_jyutping(path: str) -> dict[str, list[str]]:
    """Lines ``CHAR:reading,reading``."""
    rows = (line.split(":", 1) for line in _lines(path) if ":" in line)
    return {r[0].strip()[0]: [x.strip() for x in r[1].split(",") if x.strip()] for r in rows if r[0].strip() and r[1].strip()}


def load_romanisations(path: str) -> dict[str, list[str]]:
    """Lines ``CHAR<tab>roman,roman``; lower-cased."""
    rows = (line.split("\t", 1) for line in _lines(path) if "\t" in line)
    return {r[0][0]: [x.strip().lower() for x in r[1].split(",") if x.strip()] for r in rows if r[0]}


def char_matches_romanisation(char: str, word: str, romanisations: dict[str, list[str]]) -> bool:
    return word.lower() in romanisations.get(char, ())


def from_files(base: Dictionaries, *, strokes: str | None = None, simplified: str | None = None, traditional: str | None = None, jyutping: str | None = None) -> Dictionaries:
    """``base`` with the entries of dictionary files, which win over its own."""
    return replace(
        base,
        strokes=base.strokes | (load_strokes(strokes) if strokes else {}),
        to_simplified=base.to_simplified | (load_variants(simplified) if simplified else {}),
        to_traditional=base.to_traditional | (load_variants(traditional) if traditional else {}),
        jyutping=base.jyutping | (load_jyutping(jyutping) if jyutping else {}),
    )
