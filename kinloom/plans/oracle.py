"""SQL for DuckDB that gives the rows of the queries, from the same tables."""

from __future__ import annotations

import re

from kinloom.functions import tables
from kinloom.functions.dictionaries import strip_tone
from kinloom.plans import oracle_rules
from kinloom.sources import population

CJK = "[一-鿿㐀-䶿豈-﫿]"
_RECORDS = population.records_sql()


def _with(*ctes: str, final: str) -> str:
    return f"WITH RECURSIVE r AS ({_RECORDS}),\n" + ",\n".join(ctes) + ("\n" if ctes else "") + final if ctes else f"WITH r AS ({_RECORDS})\n{final}"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return f"MAP({_list(list(table))}, {_list(list(table.values()))})"


def _translate(expr: str) -> str:
    return f"translate({expr}, '{''.join(population.PAIRS)}', '{''.join(population.PAIRS.values())}')"


def _full(expr: str) -> str:
    back = {s: t for t, s in population.PAIRS.items()}
    return f"translate({expr}, '{''.join(back)}', '{''.join(back.values())}')"


_READ = _map({c: strip_tone(x) for c, x in tables.JYUTPING.items()})
_SURNAME = _map(tables.HK_SURNAMES)
_SPELLED = _map({s: strip_tone(tables.JYUTPING[c]) for s, c in tables.HK_SURNAMES.items()})
_COMPOUND = [r.lower().replace("-", "") for r in tables.COMPOUND_SURNAMES.values()]
_IS_HK = lambda t: f"(list_contains({_list(list(tables.HK_SURNAMES))}, lower({t})) OR list_contains({_list(_COMPOUND)}, replace(lower({t}), '-', '')))"

# Names: the population has no titles; Latin names are "SURNAME Given Names, Alias" or "Alias Surname".
_PARTS = f"""p0 AS (SELECT *, regexp_matches(name, '{CJK}') AS is_cjk, regexp_replace(name, '先生$', '') AS cut,
        list_filter(string_split(CASE WHEN contains(name, ',') THEN split_part(name, ',', 1) ELSE name END, ' '), lambda x: x <> '') AS ws,
        list_filter(string_split(CASE WHEN contains(name, ',') THEN split_part(name, ',', 2) ELSE '' END, ' '), lambda x: x <> '') AS alias FROM r),
p1 AS (SELECT *, CASE WHEN starts_with(cut, '司徒') THEN '司徒' ELSE substring(cut, 1, 1) END AS sur, len(ws) = 1 OR {_IS_HK('ws[1]')} AS first FROM p0),
p AS (SELECT idx, record_id, source, person_id, name, district, phone, CASE WHEN is_cjk THEN 'chinese' ELSE 'latin' END AS language,
        CASE WHEN is_cjk THEN sur WHEN first THEN ws[1] ELSE ws[-1] END AS family,
        CASE WHEN is_cjk THEN list_filter([substring(cut, length(sur) + 1)], lambda x: x <> '') ELSE list_concat(CASE WHEN len(ws) < 2 THEN [] WHEN first THEN ws[2:] ELSE ws[:-2] END, alias) END AS given,
        CASE WHEN is_cjk AND cut <> name THEN '先生' ELSE '' END AS honorific FROM p1)"""
_SYLLABLES = lambda w: f"list_filter(list_transform(string_split({_full(w)}, ''), lambda c: {_READ}[c]), lambda x: x IS NOT NULL)"
_KEYS = f"""k AS (SELECT *, lower(name) AS key_exact, lower({_translate('name')}) AS key_s_t, lower({_translate("concat(family, array_to_string(given, ''))")}) AS key_stripped,
        array_to_string(list_concat(CASE WHEN regexp_matches(family, '{CJK}') THEN {_SYLLABLES('family')} ELSE [coalesce({_SPELLED}[lower(family)], lower(family))] END,
            flatten(list_transform(given, lambda g: CASE WHEN regexp_matches(g, '{CJK}') THEN {_SYLLABLES('g')} ELSE [lower(g)] END))), ' ') AS key_romanized,
        CASE WHEN regexp_matches(family, '{CJK}') THEN coalesce(upper({_READ}[{_full('substring(family, 1, 1)')}]), substring(family, 1, 1))
             WHEN {_IS_HK('family')} THEN coalesce(upper({_SPELLED}[lower(family)]), upper(substring(family, 1, 1))) ELSE lower(substring(family, 1, 1)) END AS surname_key,
        CAST(CASE WHEN phone IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN district IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN language = 'chinese' THEN 15 ELSE 0 END
             + CASE WHEN len(given) > 0 THEN 10 ELSE 0 END + CASE source WHEN 'crm' THEN 10 WHEN 'billing' THEN 8 WHEN 'legacy' THEN 3 ELSE 1 END AS BIGINT) AS richness FROM p)"""


def _passes() -> list[str]:
    from kinloom.operators.seeds import PASSES

    out, left = [], "k"
    for i, (key, phone, district) in enumerate(PASSES, 1):
        value = f"CASE WHEN strlen(key_{key}) > 1 THEN key_{key} END" + (" || '|ph:' || phone" if phone else "") + (" || '|d:' || lower(district)" if district else "")
        out.append(f"g{i} AS (SELECT *, {value} AS gk FROM {left})")
        out.append(f"h{i} AS (SELECT *, CASE WHEN gk IS NOT NULL AND count(*) OVER (PARTITION BY gk) > 1 THEN min(idx) OVER (PARTITION BY gk) END AS cl FROM g{i})")
        out.append(f"l{i} AS (SELECT * EXCLUDE (gk, cl) FROM h{i} WHERE cl IS NULL)")
        left = f"l{i}"
    union = " UNION ALL ".join(f"SELECT idx, cl AS cluster_id, {i} AS pass FROM h{i} WHERE cl IS NOT NULL" for i in range(1, len(PASSES) + 1))
    phones = ", ".join(str(i) for i, p in enumerate(PASSES, 1) if p[1])
    out.append(f"m AS ({union})")
    out.append(f"""c AS (SELECT cluster_id, min(pass) AS pass, count(*) AS size, CAST(sum(richness) + 10 * count(*) AS BIGINT) AS richness,
        arg_max(idx, richness * 1000000000 + idx) AS attractor_idx, arg_max(surname_key, richness * 1000000000 + idx) AS surname_key, min(pass) IN ({phones}) AS phone_corroborated
        FROM m JOIN k USING (idx) GROUP BY cluster_id)""")
    return out


_SEEDED = [_PARTS, _KEYS, *_passes()]
_BLOCKS = """b AS (SELECT idx, unnest(list_filter([
        CASE WHEN district IS NOT NULL THEN surname_key || '|' || lower(district) END, CASE WHEN strlen(phone) >= 4 THEN surname_key || '|ph:' || right(phone, 4) END,
        CASE WHEN district IS NULL AND (phone IS NULL OR strlen(phone) < 4) THEN surname_key END], lambda x: x IS NOT NULL)) AS block FROM k WHERE surname_key <> '')"""
_NEAR = "(a_phone = b_phone OR (strlen(a_phone) = strlen(b_phone) AND strlen(a_phone) >= 7 AND left(a_phone, 7) = left(b_phone, 7)))"
_PERSON_PAIRS = """q AS (SELECT a.*, b.family AS b_family, b.given AS b_given, b.phone AS b_phone, b.district AS b_district FROM
        (SELECT idx, person_id, family, given, phone AS a_phone, district FROM p) a
        JOIN (SELECT *, unnest([person_id, person_id + 1]) AS other FROM p) b ON a.person_id = b.other WHERE a.person_id <> b.person_id OR a.idx < b.idx)"""
_ENGLISH = _list(population.ENGLISH)
_GROUPS = "[" + ", ".join(_list(g) for g in tables.SYNONYM_GROUPS) + "]"


def _address() -> str:
    from kinloom.plans.catalog import _ADDRESS

    columns = ", ".join(f"{e.format(k=k)} AS {s}_{f}" for s, k in (("a", "k"), ("b", "(3 * k + 1)")) for f, e in _ADDRESS.items())
    there = lambda f: f"(a_{f} IS NOT NULL AND b_{f} IS NOT NULL)"
    parts = [("district", 0.1, "true"), ("building", 0.3, "true"), ("estate", 0.3, f"NOT {there('building')}"), ("block", 0.15, "true"), ("floor", 0.2, "true"), ("flat", 0.25, "true")]
    weight = " + ".join(f"CASE WHEN {there(f)} AND {w} THEN {x}::DOUBLE ELSE 0::DOUBLE END" for f, x, w in parts)
    score = " + ".join(f"CASE WHEN {there(f)} AND {w} AND a_{f} = b_{f} THEN {x}::DOUBLE ELSE 0::DOUBLE END" for f, x, w in parts)
    return f"""WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), y AS (SELECT k, {columns} FROM x)
SELECT k, round(CASE WHEN {there('ogcio_ref')} THEN CASE WHEN a_ogcio_ref = b_ogcio_ref THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    WHEN {there('district')} AND a_district <> b_district THEN 0.0::DOUBLE WHEN {weight} > 0 THEN ({score}) / ({weight}) ELSE 0.0::DOUBLE END, 6) AS score FROM y"""


def _golden(rule: dict[str, str]) -> str:
    """``rule``: for each field 'complete' or 'trusted'."""
    out = []
    for field, kind in rule.items():
        if kind == "complete":
            won = f"SELECT person_id, arg_max({field}, strlen({field}) * 1000000000 + idx) AS v FROM r WHERE {field} <> '' GROUP BY person_id"
            name = "most_complete"
        else:
            order = "CASE source WHEN 'legacy' THEN 0 WHEN 'billing' THEN 1 WHEN 'crm' THEN 2 END"
            first = f"SELECT *, {order} AS o, idx = min(idx) OVER (PARTITION BY person_id, source) AS f FROM r"
            won = f"SELECT person_id, arg_min({field}, o) AS v FROM ({first}) WHERE f AND o IS NOT NULL AND {field} IS NOT NULL GROUP BY person_id"
            name = "most_trusted_source"
        out.append(f"""SELECT person_id AS cluster_id, '{field}' AS field, v AS value, arg_min(record_id, idx) AS source_record_id, arg_min(source, idx) AS source_system, '{name}' AS rule
            FROM ({won}) w JOIN r USING (person_id) WHERE r.{field} = v GROUP BY person_id, v""")
    return f"WITH r AS ({_RECORDS})\n" + "\nUNION ALL\n".join(out)


_EDGES = "e0 AS (SELECT 2 * CAST(o_orderkey AS BIGINT) AS a, 2 * CAST(o_custkey AS BIGINT) + 1 AS b FROM orders), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0)"


_CHARS = "".join(sorted({c for c in population.SURNAMES + population.GIVEN if re.match(CJK, c)}))
_BLOCK_PAIRS = "f AS (SELECT * FROM b WHERE block IN (SELECT block FROM b GROUP BY block HAVING count(*) BETWEEN 2 AND 5000)), pairs AS (SELECT DISTINCT x.idx AS a_idx, y.idx AS b_idx FROM f x JOIN f y ON x.block = y.block AND x.idx < y.idx)"
_ALL_BLOCK_PAIRS = "pairs AS (SELECT DISTINCT x.idx AS a_idx, y.idx AS b_idx FROM b x JOIN b y ON x.block = y.block AND x.idx < y.idx)"
_PERSONS = "pairs AS (SELECT a.idx AS a_idx, b.idx AS b_idx FROM r a JOIN (SELECT idx, person_id, unnest([person_id, person_id + 1]) AS other FROM r) b ON a.person_id = b.other WHERE a.person_id <> b.person_id OR a.idx < b.idx)"


def _judge(pairs: str, decided: str) -> list[str]:
    return [*oracle_rules.features(_translate, _full, _CHARS, pairs), decided]


def _matching() -> dict[str, str]:
    from kinloom.plans.catalog import JSON_RULES

    q = lambda final, *ctes: _with(*ctes, final=final)
    rules = oracle_rules.cascade()
    persons, blocks = [_PARTS, *_judge(_PERSONS, rules)], [_PARTS, _KEYS, _BLOCKS, *_judge(_BLOCK_PAIRS, rules)]
    whole = [*_SEEDED, "u AS (SELECT * FROM k WHERE idx NOT IN (SELECT idx FROM m))", _BLOCKS, *_judge(oracle_rules.STAGES, rules), oracle_rules.MATCHES]
    judged = [*whole, oracle_rules.JUDGED]
    found = "SELECT a_id AS left_id, b_id AS right_id, score, 'stage2' AS phase, rule, classification FROM dec WHERE classification <> 'non_match'"
    ordered = "SELECT DISTINCT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id"
    truth = "truth AS (SELECT x.record_id AS left_id, y.record_id AS right_id FROM r x JOIN r y ON x.person_id = y.person_id AND x.record_id < y.record_id)"
    script = lambda x: f"regexp_matches({x}.name, '{CJK}')"
    quoted = lambda c: f"'\"' || replace({c}, '\"', '\"\"') || '\"'"
    return {
        "rule_decisions": q("SELECT a_id AS a_record_id, b_id AS b_record_id, confidence, rule, score, classification, family_romanization, given_romanization, round(given_jw, 6) AS given_jw FROM dec", *persons),
        "json_rule_decisions": q("SELECT rule, confidence, classification, count(*) AS n FROM dec GROUP BY ALL", _PARTS, *_judge(_PERSONS, oracle_rules.json_cascade(JSON_RULES))),
        "block_matches": q(found, _PARTS, _KEYS, _BLOCKS, *_judge(_ALL_BLOCK_PAIRS, rules)),
        "missed_pairs": q(f"""SELECT CASE WHEN s.left_id IS NOT NULL THEN 'threshold' ELSE 'blocking' END AS reason, CASE WHEN {script('x')} <> {script('y')} THEN 'cross' WHEN {script('x')} THEN 'cjk' ELSE 'latin' END AS scripts,
    count(*) AS pairs, count(*) FILTER (x.phone = y.phone) AS same_phone FROM truth t LEFT JOIN seen_pairs s USING (left_id, right_id) JOIN r x ON x.record_id = t.left_id JOIN r y ON y.record_id = t.right_id
    WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.left_id = t.left_id AND f.right_id = t.right_id) GROUP BY 1, 2""", *blocks, truth, f"found AS ({ordered} FROM ({found}))", f"seen_pairs AS ({ordered} FROM (SELECT a_id AS left_id, b_id AS right_id FROM dec))"),
        "match_summary": q("SELECT phase, rule, classification, count(*) AS n FROM matches GROUP BY ALL", *whole),
        "matches": q("SELECT left_id, right_id, score, phase, rule, classification FROM matches", *whole),
        "precision_by_phase": q("""SELECT phase, matches, correct, correct / matches AS precision FROM (SELECT phase, count(*) AS matches, count(*) FILTER (correct) AS correct FROM judged GROUP BY phase
    UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (correct) FROM judged)""", *judged),
        "confusion_counts": q(f"""SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1
    FROM (SELECT count(*) FILTER (p.left_id IS NOT NULL AND t.left_id IS NOT NULL) AS tp, count(*) FILTER (t.left_id IS NULL) AS fp, count(*) FILTER (p.left_id IS NULL) AS fn
    FROM ({ordered} FROM matches WHERE classification = 'match') p FULL JOIN truth t ON p.left_id = t.left_id AND p.right_id = t.right_id)""", *whole, truth),
        "match_export": q(f"""SELECT left_id, left_source, {quoted('left_name')} AS left_name, right_id, right_source, {quoted('right_name')} AS right_name, phase,
    CASE score WHEN 1.0 THEN 'definite' WHEN 0.9 THEN 'high' WHEN 0.7 THEN 'medium' ELSE 'review' END AS confidence, rule, correct FROM judged""", *judged),
        "score_tiers": q("SELECT score, count(*) AS matches, count(*) FILTER (correct) AS correct FROM judged GROUP BY score", *judged),
        "entity_states": q("""SELECT CASE WHEN record_id IN (SELECT left_id FROM matches WHERE score >= 0.9 UNION SELECT right_id FROM matches WHERE score >= 0.9) THEN 'merged'
    WHEN idx IN (SELECT idx FROM m UNION SELECT idx FROM assigned) THEN 'unresolved' ELSE 'singleton' END AS state, count(*) AS n FROM r GROUP BY 1""", *whole),
        "final_clusters": q("""SELECT c.cluster_id, c.pass, count(*) AS size, CAST(sum(k.richness) + 10 * count(*) AS BIGINT) AS richness, c.attractor_idx, c.surname_key, c.phone_corroborated
    FROM c JOIN (SELECT idx, cluster_id FROM m UNION ALL SELECT idx, cluster_id FROM assigned) x ON x.cluster_id = c.cluster_id JOIN k ON k.idx = x.idx GROUP BY c.cluster_id, c.pass, c.attractor_idx, c.surname_key, c.phone_corroborated""", *whole),
        "match_clusters": q("""SELECT z.cluster_id, z.records, count(*) AS edges FROM (SELECT cluster_id, count(*) AS records FROM cl GROUP BY cluster_id) z JOIN cl ON cl.cluster_id = z.cluster_id
    JOIN matches e ON e.left_id = cl.node JOIN cl o ON o.node = e.right_id AND o.cluster_id = cl.cluster_id GROUP BY z.cluster_id, z.records""", *whole,
            "e2 AS (SELECT left_id AS a, right_id AS b FROM matches WHERE classification = 'match' UNION SELECT right_id, left_id FROM matches WHERE classification = 'match')",
            "reach(node, other) AS (SELECT a, a FROM e2 UNION SELECT reach.node, e2.b FROM reach JOIN e2 ON reach.other = e2.a)",
            "cl AS (SELECT node, min(other) AS cluster_id FROM reach GROUP BY node)"),
    }


def build() -> dict[str, str]:
    q = lambda final, *ctes: _with(*ctes, final=final)
    script = f"CASE WHEN regexp_matches(name, '{CJK}') AND NOT regexp_matches(name, '[A-Za-z]') THEN 'cjk' WHEN regexp_matches(name, '[A-Za-z]') AND NOT regexp_matches(name, '{CJK}') THEN 'latin' ELSE 'mixed' END"
    rest = "array_to_string(list_filter(string_split(replace(name, ',', ' '), ' '), lambda x: x <> ''), ' ')"
    components = "SELECT record_id, language, family, array_to_string(given, '/') AS given, honorific FROM p WHERE language = '{}'"
    return {
        "records": q("SELECT * FROM r"),
        "script_profile": q(f"SELECT source, {script} AS script, count(*) AS n FROM r GROUP BY 1, 2"),
        "language_profile": q(f"SELECT CASE WHEN regexp_matches(name, '{CJK}') THEN 'chinese' ELSE 'unknown' END AS language, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(name, '{CJK}') THEN 1 ELSE 0 END) AS BIGINT) AS with_cjk FROM r GROUP BY 1"),
        "ngram_counts": q(f"SELECT gram, count(*) AS n FROM (SELECT unnest(CASE WHEN length(name) < 2 THEN [name] ELSE list_transform(range(1, length(name)), lambda i: substring(name, i, 2)) END) AS gram FROM r WHERE regexp_matches(name, '{CJK}')) GROUP BY gram"),
        "document_ngrams": """WITH g AS (SELECT lang, list_transform(range(1, length(lang)), lambda i: substring(lang, i, 2)) AS x, list_transform(range(1, length(source)), lambda i: substring(source, i, 2)) AS y, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS n FROM documents)
SELECT lang, sum(len(list_filter(x, lambda v: list_contains(y, v))) / (len(x) + len(y) - len(list_filter(x, lambda v: list_contains(y, v))))) AS similarity, CAST(sum(n) AS BIGINT) AS chars FROM g GROUP BY lang""",
        "normalised_names": q("SELECT record_id, lower(array_to_string(list_filter(string_split(name, ' '), lambda x: x <> ''), ' ')) AS normal FROM r"),
        "name_tokens_latin": q(f"""SELECT record_id, {rest} AS stripped, lower({rest}) AS normalized, CAST(len(string_split({rest}, ' ')) AS INTEGER) AS n_tokens,
    CASE WHEN idx % 3 = 0 THEN 'Dr,Prof' ELSE '' END AS titles, CASE WHEN idx % 2 = 0 THEN 'MBA,Jr' ELSE '' END AS suffixes FROM r WHERE NOT regexp_matches(name, '{CJK}')"""),
        "components_latin": q(components.format("latin"), _PARTS),
        "components_cjk": q(components.format("chinese"), _PARTS),
        "cjk_name_stripped": q(f"SELECT record_id, regexp_replace(name, '先生$', '') AS stripped, CAST(length(regexp_replace(name, '先生$', '')) AS INTEGER) AS n_chars FROM r WHERE regexp_matches(name, '{CJK}')"),
        "hk_surnames": q(f"SELECT token, count(*) AS n, {_IS_HK('token')} AS known, {_SURNAME}[lower(token)] AS char FROM (SELECT split_part(name, ' ', 1) AS token FROM r WHERE NOT regexp_matches(name, '{CJK}')) GROUP BY token"),
        "synonym_pairs": f"WITH e AS (SELECT unnest({_ENGLISH}) AS a), g AS (SELECT unnest({_GROUPS}) AS names) SELECT DISTINCT x.a, y.a AS b FROM e x JOIN e y ON x.a < y.a JOIN g ON list_contains(names, lower(x.a)) AND list_contains(names, lower(y.a))",
        "jw_token_pairs": q("SELECT x.a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 6) AS score FROM w x JOIN w y ON left(x.a, 1) = left(y.a, 1) AND x.a < y.a", f"w AS (SELECT DISTINCT unnest(list_filter(string_split(lower(replace(name, ',', ' ')), ' '), lambda x: x <> '')) AS a FROM r WHERE NOT regexp_matches(name, '{CJK}'))"),
        "address_scores": _address(),
        "sql_address_scores": _address(),
        "sql_parsed_names": q("SELECT record_id, language, family, array_to_string(given, '/') AS given, honorific FROM p", _PARTS),
        "sql_ngram_similarities": q("""SELECT a, b, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_filter(x, lambda g: list_contains(y, g))) / (len(x) + len(y) - len(list_filter(x, lambda g: list_contains(y, g)))) END::DOUBLE, 6) AS score FROM grams""",
            """names AS (SELECT DISTINCT replace(s.name, '先生', '') AS a, replace(t.name, '先生', '') AS b FROM r s JOIN r t ON s.person_id = t.person_id AND s.idx < t.idx)""",
            """grams AS (SELECT a, b, list_transform(range(1, length(replace(a, ' ', ''))), lambda i: substring(replace(a, ' ', ''), i, 2)) AS x, list_transform(range(1, length(replace(b, ' ', ''))), lambda i: substring(replace(b, ' ', ''), i, 2)) AS y FROM names)"""),
        "st_normalized_names": q(f"SELECT {_translate('name')} AS simplified, count(*) AS n FROM r GROUP BY 1"),
        "surname_keys": q("SELECT surname_key, count(*) AS n, CAST(sum(richness) AS BIGINT) AS richness FROM k GROUP BY 1", _PARTS, _KEYS),
        "name_keys": q("SELECT record_id, key_exact, key_s_t, key_stripped, key_romanized FROM k", _PARTS, _KEYS),
        "richness": q("SELECT record_id, richness FROM k", _PARTS, _KEYS),
        "phone_nodes": q(f"""SELECT phone, district, count(*) AS n FROM (SELECT coalesce({_NEAR}, false) AS phone, coalesce(lower(a_district) = lower(b_district), false) AS district FROM
    (SELECT person_id AS p, phone AS a_phone, district AS a_district FROM r WHERE source = 'billing') JOIN (SELECT unnest([person_id, person_id + 5]) AS p, phone AS b_phone, district AS b_district FROM r WHERE source = 'crm') USING (p)) GROUP BY 1, 2"""),
        "phase1_pass_counts": q("SELECT pass, count(*) AS records, count(DISTINCT cluster_id) AS clusters FROM m GROUP BY pass", *_SEEDED),
        "seed_clusters": q("SELECT * FROM c", *_SEEDED),
        "seed_membership": q("SELECT cluster_id, record_id, CASE WHEN idx = attractor_idx THEN 'attractor' ELSE 'member' END AS role FROM m JOIN c USING (cluster_id) JOIN r USING (idx)", *_SEEDED),
        "cluster_sizes": q("SELECT count(*) AS clusters, avg(n) AS mean_size, max(n) AS largest, count(*) FILTER (n = 2) AS two, count(*) FILTER (n = 3) AS three, count(*) FILTER (n >= 4) AS four_or_more FROM (SELECT count(*) AS n FROM m GROUP BY cluster_id)", *_SEEDED),
        "unconsumed": q("SELECT record_id, surname_key FROM k WHERE idx NOT IN (SELECT idx FROM m)", *_SEEDED),
        "block_sizes": q("SELECT block, count(*) AS n FROM b GROUP BY block HAVING count(*) BETWEEN 2 AND 5000", _PARTS, _KEYS, _BLOCKS),
        "block_statistics": q("SELECT count(*) FILTER (n <= 5000) AS blocks, max(n) AS largest, count(*) FILTER (n > 5000) AS skipped, CAST(sum(CASE WHEN n <= 5000 THEN n * (n - 1) // 2 ELSE 0 END) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM b GROUP BY block HAVING count(*) >= 2)", _PARTS, _KEYS, _BLOCKS),
        "candidate_pairs": q("SELECT DISTINCT x.idx AS a_idx, y.idx AS b_idx FROM f x JOIN f y ON x.block = y.block AND x.idx < y.idx", _PARTS, _KEYS, _BLOCKS, "f AS (SELECT * FROM b WHERE block IN (SELECT block FROM b GROUP BY block HAVING count(*) BETWEEN 2 AND 5000))"),
        "first_char_blocks": q("SELECT lower(substring(name, 1, 1)) AS block, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 2"),
        "cluster_candidates": q("SELECT u.idx AS a_idx, c.attractor_idx AS b_idx, cluster_id FROM (SELECT * FROM k WHERE idx NOT IN (SELECT idx FROM m)) u JOIN c ON u.surname_key = c.surname_key AND u.surname_key <> '' JOIN r t ON t.idx = c.attractor_idx WHERE u.phone IS NULL OR t.phone IS NULL OR u.phone = t.phone", *_SEEDED),
        "rule_decisions_native": q(f"""SELECT fe AND ge AS r1, fe AS family_exact, pm AS phone_match, dm AS district_match, count(*) AS n FROM (SELECT lower(family) IS NOT DISTINCT FROM lower(b_family) AS fe,
    list_transform(given, lambda x: lower(x)) = list_transform(b_given, lambda x: lower(x)) AS ge, coalesce({_NEAR}, false) AS pm, coalesce(lower(district) = lower(b_district), false) AS dm FROM q) GROUP BY ALL""", _PARTS, _PERSON_PAIRS),
        "collision_routing": q("SELECT sharing, sharing <= 3 AS trusted, count(*) AS n FROM (SELECT CASE WHEN phone IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY key_romanized, phone) END AS sharing FROM k) GROUP BY 1, 2", _PARTS, _KEYS),
        "truth_pairs": q("SELECT x.record_id AS left_id, y.record_id AS right_id FROM r x JOIN r y ON x.person_id = y.person_id AND x.record_id < y.record_id"),
        "truth_groups": q("SELECT person_id, array_to_string(list_sort(list(DISTINCT record_id)), ',') AS record_ids FROM r GROUP BY person_id"),
        "top_surnames": q("SELECT surname_key, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, surname_key LIMIT 10", _PARTS, _KEYS),
        "connected_components": f"WITH RECURSIVE {_EDGES}, w(node, reach) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.reach = e.a) SELECT node, min(reach) AS component FROM w GROUP BY node",
        "golden_most_complete": _golden({"name": "complete", "district": "complete", "phone": "complete"}),
        "golden_trusted_source": _golden({"name": "complete", "district": "trusted", "phone": "trusted"}),
        **_matching(),
    }
