"""SQL for DuckDB that gives the rows of the matching half: name features, the rule cascade, JSON rules, the phases.

It is written for the synthetic population: CJK given names have at most two characters, Latin tokens are ASCII. Name
features are computed once for each pair of name forms, from a table of all pairs of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from kinloom.functions import tables
from kinloom.functions.dictionaries import strip_tone

CJK = "[一-鿿㐀-䶿豈-﫿]"
LEVELS = ("non_match", "review", "medium", "high", "definite")


def _ascii(expr: str, chars: str) -> str:
    """CJK characters as ASCII ones, so that a similarity of bytes is one of characters."""
    codes = "".join(chr(c) for c in range(33, 127) if chr(c) not in "'\\")
    if len(chars) > len(codes):
        raise ValueError("too many characters")
    return f"translate({expr}, '{chars}', '{codes[: len(chars)]}')"


def features(simplified: Callable[[str], str], full: Callable[[str], str], chars: str, pairs: str) -> list[str]:
    """Common table expressions from ``p`` (parts of names) and ``pairs`` (a_idx, b_idx) to ``dec``: all decisions."""
    reading = ", ".join(f"'{c}': '{strip_tone(r)}'" for c, r in tables.JYUTPING.items())
    spelled = ", ".join("{'syl': '%s', 'ord': %d, 'words': [%s]}" % (s, i, ", ".join(f"'{w}'" for w in ws)) for i, (s, ws) in enumerate(tables.ROMANISATIONS))
    synonyms = "[" + ", ".join("[" + ", ".join(f"'{n}'" for n in g) + "]" for g in tables.SYNONYM_GROUPS) + "]"
    bigrams = lambda x: f"CASE WHEN length({x}) < 2 THEN [] ELSE list_transform(range(1, length({x})), lambda i: substring({x}, i, 2)) END"
    return [
        "words AS (SELECT DISTINCT t FROM (SELECT unnest(given) AS t FROM p UNION ALL SELECT family FROM p))",
        f"""sounds AS (SELECT t, list_transform(string_split(t, ''), lambda c: coalesce(MAP {{{reading}}}[c], '')) AS syllables FROM words WHERE regexp_matches(t, '{CJK}'))""",
        f"spellings AS (SELECT unnest([{spelled}], recursive := true))",
        f"latin AS (SELECT DISTINCT lower(t) AS w FROM words WHERE NOT regexp_matches(t, '{CJK}'))",
        # an entry of the syllable decides if it holds the word, or one of its spellings is close; the first that decides counts
        """spoken AS (SELECT syl, w, coalesce(arg_min(v, ord) FILTER (v > 0.85), any_value(jaro_winkler_similarity(syl, w))) AS score FROM (
            SELECT s.syl, w, ord, CASE WHEN list_contains(words, w) THEN 1.0 ELSE list_max(list_transform(words, lambda x: jaro_winkler_similarity(x, w))) END AS v
            FROM (SELECT DISTINCT unnest(syllables) AS syl FROM sounds) s CROSS JOIN latin LEFT JOIN spellings USING (syl) WHERE s.syl <> '') GROUP BY syl, w)""",
        """crossed AS (SELECT t, w, max(score) / any_value(n) AS score FROM (SELECT t, len(syllables) AS n, unnest(syllables) AS syl FROM sounds) JOIN spoken USING (syl) GROUP BY t, w)""",
        f"""tokens AS (SELECT x, y, lower(x) = lower(y) AS eq, cx AND cy AND length(x) = length(y) AND ({simplified('x')} = {simplified('y')} OR {full('x')} = {full('y')}) AS variant,
            len(list_filter({synonyms}, lambda g: list_contains(g, lower(x)) AND list_contains(g, lower(y)))) > 0 AS synonym, cx <> cy AND coalesce(c.score, 0) > 0.7 AS spoken,
            CASE WHEN cx AND cy THEN jaro_winkler_similarity({_ascii('x', chars)}, {_ascii('y', chars)}) WHEN cx <> cy THEN 0.0 ELSE jaro_winkler_similarity(lower(x), lower(y)) END AS jw
            FROM (SELECT a.t AS x, b.t AS y, regexp_matches(a.t, '{CJK}') AS cx, regexp_matches(b.t, '{CJK}') AS cy FROM words a CROSS JOIN words b)
            LEFT JOIN crossed c ON c.t = CASE WHEN cx THEN x ELSE y END AND c.w = lower(CASE WHEN cx THEN y ELSE x END))""",
        pairs,
        """q2 AS (SELECT a_idx, b_idx, a.record_id AS a_id, b.record_id AS b_id, a.family AS fa, a.given AS ga, b.family AS fb, b.given AS gb, a.phone AS a_phone, b.phone AS b_phone
            FROM pairs JOIN p a ON a.idx = a_idx JOIN p b ON b.idx = b_idx)""",
        """forms AS (SELECT *, CASE WHEN len(ga) <= len(gb) THEN ga ELSE gb END AS s, CASE WHEN len(ga) <= len(gb) THEN gb ELSE ga END AS l FROM (SELECT DISTINCT fa, ga, fb, gb FROM q2))""",
        """met AS (SELECT fa, ga, fb, gb, i, j, t.* FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM forms)) f JOIN tokens t ON t.x = f.s[i] AND t.y = f.l[j])""",
        # a token looks at the other side's tokens up to the first one that equals it
        "seen AS (SELECT * FROM (SELECT *, min(CASE WHEN eq THEN j END) OVER (PARTITION BY fa, ga, fb, gb, i) AS stop FROM met) WHERE j <= coalesce(stop, j))",
        """by_token AS (SELECT fa, ga, fb, gb, i, bool_or(eq OR variant) AS same, bool_or(NOT eq AND NOT variant AND synonym) AS synonym, bool_or(NOT eq AND NOT variant AND NOT synonym AND spoken) AS spoken,
            max(CASE WHEN eq THEN 1.0 WHEN variant THEN 0.98 WHEN synonym THEN 0.99 WHEN spoken THEN 0.95 ELSE jw END::DOUBLE) AS best FROM seen GROUP BY ALL)""",
        "by_form AS (SELECT fa, ga, fb, gb, bool_and(same) AS same, bool_or(synonym) AS synonym, bool_or(spoken) AS spoken, max(best) AS jw, count(*) FILTER (best > 0.8) AS close, count(*) AS n FROM by_token GROUP BY ALL)",
        f"""named AS (SELECT f.*, list_transform(ga, lambda x: lower(x)) = list_transform(gb, lambda x: lower(x)) AS given_exact, lower(fa) = lower(fb) AS family_exact,
            ft.variant AND NOT ft.eq AS family_st, ft.spoken AND NOT ft.eq AND NOT ft.variant AS family_romanization, len(ga) = 0 OR len(gb) = 0 AS given_missing,
            coalesce(b.synonym, false) AS given_synonym, coalesce(b.spoken, false) AS given_romanization, coalesce(b.close > 0 AND b.close < b.n, false) AS given_partial,
            coalesce(b.same, false) AND len(ga) = len(gb) AND len(ga) > 0 AND regexp_matches(array_to_string(ga, ''), '{CJK}') AND regexp_matches(array_to_string(gb, ''), '{CJK}') AS given_st,
            regexp_replace({simplified("array_to_string(ga, '')")}, '[ -~]', '', 'g') AS ca, regexp_replace({simplified("array_to_string(gb, '')")}, '[ -~]', '', 'g') AS cb, b.jw AS jw
            FROM forms f JOIN tokens ft ON ft.x = fa AND ft.y = fb LEFT JOIN by_form b USING (fa, ga, fb, gb))""",
        f"""nodes AS (SELECT *, coalesce(jw, CASE WHEN given_exact THEN 1.0 ELSE 0.0 END)::DOUBLE AS given_jw,
            CASE WHEN ca = '' OR cb = '' THEN 0.0 WHEN ca = cb THEN 1.0 WHEN len(list_intersect(string_split(ca, ''), string_split(cb, ''))) > 0 THEN 1.0 / greatest(length(ca), length(cb)) ELSE 0.0 END AS lcs,
            CASE WHEN length(ca) > 1 AND length(cb) > 1 THEN len(list_intersect({bigrams('ca')}, {bigrams('cb')})) / len(list_distinct(list_concat({bigrams('ca')}, {bigrams('cb')}))) ELSE 0.0 END AS jaccard FROM named)""",
        f"""joined AS (SELECT q2.*, n.* EXCLUDE (fa, ga, fb, gb, s, l, ca, cb, jw), family_exact OR family_st OR family_romanization AS fm,
            given_exact OR given_partial OR given_jw > 0.85 OR given_romanization OR given_st AS gs,
            coalesce(a_phone = b_phone OR (strlen(a_phone) = strlen(b_phone) AND strlen(a_phone) >= 7 AND left(a_phone, 7) = left(b_phone, 7)), false) AS ph FROM q2 JOIN nodes n USING (fa, ga, fb, gb))""",
    ]


def cascade() -> str:
    """``dec``: joined with level and rule of the built-in cascade; in this population only phones corroborate."""
    two = lambda test, yes, no, label, unsure=" (uncorroborated)": [(f"{test} AND ph", yes, f"'{label} + corroborated'"), (test, no, f"'{label}{unsure}'")]
    rows = [
        ("family_exact AND given_exact", 4, "'R1: family exact + given exact'"),
        ("(family_exact OR family_st) AND (given_exact OR given_st)", 4, "'R2: family S↔T + given S↔T'"),
        ("family_exact AND given_synonym", 3, "'R3: family exact + given synonym'"),
        ("fm AND ph AND gs", 3, "'R3d: family + phone + given signal'"),
        ("fm AND jaccard = 1.0", 3, "'R3b: family match + CJK given bigram exact (J=1.00)'"),
        ("fm AND lcs >= 0.5 AND ph", 2, "printf('R3c: family match + CJK given LCS %.0f%% + corroborated', lcs * 100)"),
        *two("fm AND given_romanization", 3, 2, "R4: family match + given romanization"),
        *two("family_romanization AND given_exact", 3, 2, "R5: family romanization + given exact"),
        *two("fm AND given_partial", 2, 1, "R8: family match + given partial"),
        *two("fm AND given_missing", 1, 0, "R9: family match + given missing", " (uncorroborated — insufficient)"),
    ]
    return _decided(rows, "no rule matched")


def json_cascade(rules: list[dict]) -> str:
    names = {"family_match": "fm", "phone_match": "ph", "given_bigram_jaccard": "jaccard"}
    rows = []
    for r in rules:
        parts = []
        for part in r["condition"].split(" && "):
            word, rest = part.lstrip("!").split(" ", 1) if " " in part else (part.lstrip("!"), "")
            parts.append(("NOT " if part.startswith("!") else "") + f"({names.get(word, word)} {rest})")
        rows.append((" AND ".join(parts), LEVELS.index(r["confidence"]), "'" + r["condition"] + "'"))
    return _decided(rows, "no JSON rule matched")


def _decided(rows: list[tuple[str, int, str]], none: str) -> str:
    level = "CASE " + " ".join(f"WHEN {t} THEN {k}" for t, k, _ in rows) + " ELSE 0 END"
    rule = "CASE " + " ".join(f"WHEN {t} THEN {label}" for t, _, label in rows) + f" ELSE '{none}' END"
    return f"""dec AS (SELECT *, CAST(CASE confidence WHEN 4 THEN 1.0 WHEN 3 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.0 END AS DOUBLE) AS score,
        CASE WHEN confidence >= 3 THEN 'match' WHEN confidence = 2 THEN 'possible' ELSE 'non_match' END AS classification FROM (SELECT *, CAST({level} AS INTEGER) AS confidence, {rule} AS rule FROM joined))"""


#: Pairs of the resolution: members with their attractors, leftover records with attractors, leftover records in blocks.
STAGES = """phased AS (SELECT m.idx AS b_idx, c.attractor_idx AS a_idx, '2a' AS ph, cluster_id, c.richness FROM m JOIN c USING (cluster_id) WHERE c.phone_corroborated AND m.idx <> c.attractor_idx
    UNION ALL SELECT c.attractor_idx, u.idx, '2b', cluster_id, c.richness FROM u JOIN c ON u.surname_key = c.surname_key AND u.surname_key <> '' JOIN r t ON t.idx = c.attractor_idx WHERE u.phone IS NULL OR t.phone IS NULL OR u.phone = t.phone
    UNION ALL SELECT DISTINCT y.idx, x.idx, '3', NULL, NULL FROM b x JOIN b y ON x.block = y.block AND x.idx < y.idx JOIN u ON u.idx = x.idx JOIN u v ON v.idx = y.idx),
pairs AS (SELECT DISTINCT a_idx, b_idx FROM phased)"""
#: Matches of the resolution from the decisions. Blocks are those of the records that no cluster took.
MATCHES = """assigned AS (SELECT a_idx AS idx, arg_max(cluster_id, confidence * 1000000000000000 + richness * 10000000000 - cluster_id) AS cluster_id, arg_max(b_id, confidence * 1000000000000000 + richness * 10000000000 - cluster_id) AS b_id,
    arg_max(rule, confidence * 1000000000000000 + richness * 10000000000 - cluster_id) AS rule, arg_max(score, confidence * 1000000000000000 + richness * 10000000000 - cluster_id) AS score, any_value(a_id) AS a_id
    FROM (SELECT dec.*, f.cluster_id, f.richness FROM dec JOIN phased f USING (a_idx, b_idx) WHERE f.ph = '2b' AND confidence >= 3) GROUP BY a_idx),
matches AS (SELECT a_id AS left_id, b_id AS right_id, score, 'phase2a' AS phase, 'phase2a_' || rule AS rule, classification FROM dec JOIN phased f USING (a_idx, b_idx) WHERE f.ph = '2a' AND confidence >= 3
    UNION ALL SELECT a_id, b_id, score, 'phase2b', 'phase2_' || rule, 'match' FROM assigned
    UNION ALL SELECT a_id, b_id, score, 'stage2', rule, classification FROM dec JOIN phased f USING (a_idx, b_idx) WHERE f.ph = '3' AND confidence >= 2 AND a_idx NOT IN (SELECT idx FROM assigned) AND b_idx NOT IN (SELECT idx FROM assigned))"""
JUDGED = """judged AS (SELECT m2.*, x.source AS left_source, y.source AS right_source, x.name AS left_name, y.name AS right_name, x.person_id = y.person_id AS correct
    FROM matches m2 JOIN r x ON x.record_id = left_id JOIN r y ON y.record_id = right_id)"""
