"""One value at a time: what SQL functions need in Python, with the same results as the Columns of ``names`` and ``text``."""

from __future__ import annotations

import json
import re

from kinloom.functions import tables, text
from kinloom.functions.kernels import Comparer, has_cjk

_KANA, _HANGUL = (re.compile(c.encode().decode("unicode_escape")) for c in (text.KANA_CLASS, text.HANGUL_CLASS))
PARTS = ("district", "building", "estate", "block", "floor", "flat")
WEIGHTS = {"district": 0.1, "building": 0.3, "estate": 0.3, "block": 0.15, "floor": 0.2, "flat": 0.25}
_SPACE = re.compile("[ \t\n\x0b\f\r]+")  # what \s is in a Column's pattern
_COMPOUND_SPELLINGS = {r.lower().replace("-", "") for r in tables.COMPOUND_SURNAMES.values()}


def language(raw: str) -> str:
    return "Japanese" if _KANA.search(raw) else "Korean" if _HANGUL.search(raw) else "Chinese" if has_cjk(raw) else "Latin"


def _words(s: str) -> list[str]:
    return [w for w in _SPACE.split(s) if w]


def ngrams(s: str, n: int = 2) -> list[str]:
    s = _SPACE.sub("", s)
    return [] if not s else [s] if len(s) < n else [s[i : i + n] for i in range(len(s) - n + 1)]


def ngram_similarity(a: str, b: str, n: int = 2) -> float:
    """Windows of a (repeats counted) that occur in b, over all windows less those; both empty 1, one empty 0."""
    x, y = ngrams(a, n), ngrams(b, n)
    if not x or not y:
        return float(not x and not y)
    shared = sum(g in set(y) for g in x)
    return shared / (len(x) + len(y) - shared)


def _is_hk_surname(word: str) -> bool:
    return word.lower() in tables.HK_SURNAMES or word.lower().replace("-", "") in _COMPOUND_SPELLINGS


def _latin(raw: str) -> dict:
    main, _, alias = raw.partition(",")
    words = _words(re.sub("[.-]", " ", main))
    head = next((i for i, w in enumerate(words) if w.lower() not in tables.SALUTATIONS), len(words))
    body = words[head:]
    tail = next((i for i, w in enumerate(reversed(body)) if w.lower() not in tables.SUFFIXES), len(body))
    core = body[: len(body) - tail]
    first = len(core) == 1 or bool(core) and _is_hk_surname(core[0])
    family = core[0] if core and first else core[-1] if core else None
    given = [] if len(core) < 2 else core[1:] if first else core[:-1]
    return {
        "title": words[0] if head else None, "family": family, "given": given + _words(alias.replace(".", " ")),
        "suffix": body[-1] if tail else None, "prefix": None, "honorific": None,
    }


def _cjk(raw: str, kind: str) -> dict:
    trimmed = raw.strip(" \t\n\x0b\f\r")
    prefix = trimmed[0] if kind == "Chinese" and trimmed[:1] in tables.CHINESE_PREFIXES and len(trimmed) > 1 else None
    rest = trimmed[1:] if prefix else trimmed
    endings = [*tables.SHARED_HONORIFICS, *{"Japanese": tables.JAPANESE_HONORIFICS, "Korean": tables.KOREAN_HONORIFICS}.get(kind, [])]
    honorific = next((h for h in endings if rest.endswith(h) and len(rest) > len(h)), None)
    cut = rest[: len(rest) - len(honorific)] if honorific else rest
    name = _SPACE.sub("", cut)
    family, given = None, list(name)
    if kind == "Chinese" and name:
        surname = next((c for c in tables.COMPOUND_SURNAMES if cut.startswith(c)), name[0])
        left = name if prefix else name[len(surname) :]
        family, given = None if prefix else surname, [left] if left else []
    return {"title": None, "family": family, "given": given, "suffix": None, "prefix": prefix, "honorific": honorific}


def components(raw: str) -> dict:
    """The typed parts of a name of any script."""
    kind = language(raw)
    return {"raw": raw, "language": kind, **(_latin(raw) if kind == "Latin" else _cjk(raw, kind))}


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def parse_name(raw: str) -> str:
    return _json(components(raw))


def compare_names(comparer: Comparer, a: str, b: str, use_synonyms: bool, penalty: float) -> str:
    left, right = components(a), components(b)
    return _json({"left": left, "right": right, "result": comparer.names(left, right, use_synonyms, penalty)})


def _address(text_: str) -> dict:
    value = json.loads(text_)
    if not isinstance(value, dict) or not isinstance(value.get("raw"), str):
        raise ValueError("not an address: raw is missing")
    return value


def address_score(a: dict, b: dict) -> float:
    """As ``text.address_similarity``."""
    there = lambda f: a.get(f) is not None and b.get(f) is not None
    if there("ogcio_ref"):
        return float(a["ogcio_ref"] == b["ogcio_ref"])
    if there("district") and a["district"] != b["district"]:
        return 0.0
    weights = {f: w for f, w in WEIGHTS.items() if there(f) and not (f == "estate" and there("building"))}
    return sum(w for f, w in weights.items() if a[f] == b[f]) / sum(weights.values()) if weights else 0.0


def compare_addresses(a: str, b: str) -> str:
    try:
        x, y = _address(a), _address(b)
    except ValueError as error:
        return _json({"error": str(error)})
    return _json({"score": address_score(x, y), **{side: {f: v.get(f) for f in PARTS} for side, v in (("a", x), ("b", y))}})
