"""The queries in plain SQL, for comparison on the same tables.

A query is a chain of named relations and a final SELECT; ``chain`` puts together what it needs.
"""

from __future__ import annotations

from ..functions import vocabulary as V
from ..functions.text import last_words, suffixes
from ..sources.adapters import SQL as SOURCES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _in(words) -> str:
    return "(" + ", ".join(map(_text, words)) + ")"


def _suffixes(country: str | None) -> str:
    return "[" + ", ".join(f"{{'w': {_list(s.split())}, 'c': {_text(V.SUFFIX_CANONICAL.get(s, ''))}}}" for s in suffixes(country)) + "]"


def _plain(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[\p{{P}}\p{{S}}]', ' ', 'g'), '\s+', ' ', 'g'))"


_SHORT = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in V.ADDRESS_SHORT.items()) + "}"
_TITLE = r"'(?i)^(" + "|".join(V.HONORIFICS) + r")\b[\s.\-/]*'"
_NAME = f"t NOT IN {_in(V.NAME_STOP_TOKENS)} AND length(t) >= 3"
_NUMBER = r"regexp_full_match(t, '\p{Nd}+')"
_ADDRESS = f"t NOT IN {_in(V.ADDRESS_STOP_TOKENS)} AND (length(t) >= 4 OR ({_NUMBER} AND length(t) >= 2))"


def relations(name_df=400, addr_df=150, bigram_df=200, block=500, cap=500, target="source <> 'S1'") -> dict[str, str]:
    worth = "length(bin(greatest(df, 2) - 1))"
    return {
        "sources": SOURCES,
        "pre": f"""
cons AS MATERIALIZED (SELECT entity_id, source, country, business_name AS name_raw, {_plain("business_name")} AS name_conservative, business_address AS addr_raw, {_plain("business_address")} AS addr_conservative FROM src),
words AS MATERIALIZED (SELECT *, list_filter(string_split(name_conservative, ' '), lambda t: t <> '') AS w FROM cons),
plain AS MATERIALIZED (SELECT entity_id, country, list_transform(w, lambda t: strip_accents(t)) AS p FROM words),
suf AS MATERIALIZED (SELECT {_suffixes("France")} AS fr, {_suffixes("India")} AS hi, {_suffixes(None)} AS other),
strip(entity_id, country, p, n, c) AS (
  SELECT entity_id, country, p, len(p)::BIGINT, '' FROM plain
  UNION ALL SELECT entity_id, country, p, n - len(f.w), CASE WHEN c = '' THEN f.c ELSE c END FROM (
    SELECT s.*, list_filter(CASE s.country WHEN 'France' THEN fr WHEN 'India' THEN hi ELSE other END, lambda x: len(x.w) < s.n AND list_slice(s.p, s.n - len(x.w) + 1, s.n) = x.w
      AND len(list_filter(list_slice(s.p, 1, s.n - len(x.w)), lambda t: NOT list_contains({_list(V.STOP_WORDS)}, t))) > 0)[1] AS f
    FROM strip s, suf WHERE list_contains({_list(last_words())}, s.p[s.n])) WHERE f IS NOT NULL),
last AS MATERIALIZED (SELECT entity_id, arg_min(c, n) AS suffix, min(n) AS n FROM strip GROUP BY entity_id),
core AS MATERIALIZED (SELECT words.*, last.suffix AS name_corporate_suffix, trim(regexp_replace(strip_accents(array_to_string(list_slice(w, 1, last.n), ' ')), '\\s+', ' ', 'g')) AS core_name,
  trim(regexp_replace(strip_accents(array_to_string(list_transform(list_filter(string_split(addr_conservative, ' '), lambda t: t <> ''), lambda t: coalesce({_SHORT}[t], t)), ' ')), '\\s+', ' ', 'g')) AS addr_normalized
  FROM words JOIN last USING (entity_id)),
norm AS MATERIALIZED (SELECT *, CASE WHEN core_name <> '' THEN core_name ELSE name_conservative END AS name_normalized, addr_conservative = '' AS addr_is_empty, CASE WHEN country = '' THEN 'UNKNOWN' ELSE country END AS cc FROM core),
pre AS MATERIALIZED (SELECT *, list_filter(string_split(name_normalized, ' '), lambda t: t <> '') AS toks, CASE WHEN addr_is_empty THEN []::VARCHAR[] ELSE list_filter(string_split(addr_normalized, ' '), lambda t: t <> '') END AS atoks,
  trim(regexp_replace(name_normalized, {_TITLE}, '')) AS clean, replace(name_normalized, ' ', '') AS compact FROM norm)""",
        "keys": f"""
tgt AS MATERIALIZED (SELECT * FROM pre WHERE {target}),
keys AS MATERIALIZED (
  SELECT 'exact_name' AS pass, cc AS country, key, entity_id FROM (SELECT cc, entity_id, unnest(list_distinct(list_filter([name_normalized, clean], lambda x: x <> ''))) AS key FROM tgt WHERE name_normalized <> '')
  UNION ALL SELECT 'exact_conservative', cc, name_conservative, entity_id FROM tgt WHERE name_conservative <> name_normalized AND name_conservative <> ''
  UNION ALL SELECT 'sorted_name', cc, array_to_string(list_sort(toks), ' '), entity_id FROM tgt WHERE len(toks) >= 2
  UNION ALL SELECT 'name_bigram', cc, toks[i] || '_' || toks[i + 1], entity_id FROM (SELECT *, unnest(range(1, len(toks))) AS i FROM tgt)
  UNION ALL SELECT 'name_token', cc, t, entity_id FROM (SELECT cc, entity_id, unnest(toks) AS t FROM tgt) WHERE {_NAME}
  UNION ALL SELECT 'addr_token', cc, t, entity_id FROM (SELECT cc, entity_id, unnest(atoks) AS t FROM tgt) WHERE {_ADDRESS}
  UNION ALL SELECT 'prefix_6gram', cc, compact[1:6], entity_id FROM tgt WHERE length(compact) >= 6),
freq AS MATERIALIZED (SELECT pass, country, key, CASE WHEN pass = 'sorted_name' THEN least(count(*), {block}) ELSE count(*) END AS df FROM keys GROUP BY pass, country, key
  HAVING count(*) <= CASE pass WHEN 'name_bigram' THEN {bigram_df} WHEN 'name_token' THEN {name_df} WHEN 'addr_token' THEN {addr_df} WHEN 'prefix_6gram' THEN {block} ELSE count(*) END),
kept AS MATERIALIZED (SELECT * FROM keys QUALIFY pass <> 'sorted_name' OR row_number() OVER (PARTITION BY pass, country, key ORDER BY entity_id) <= {block})""",
        "hits": f"""
qry AS MATERIALIZED (SELECT * FROM pre WHERE source = 'S1'),
probes AS MATERIALIZED (
  SELECT entity_id AS s1_id, 'exact_name' AS pass, cc AS country, name_normalized AS key, 0 AS pos, 0 AS grp, 100 AS base FROM qry WHERE name_normalized <> ''
  UNION ALL SELECT entity_id, 'exact_name', cc, clean, 0, 0, 95 FROM qry WHERE name_normalized <> '' AND clean <> name_normalized AND clean <> ''
  UNION ALL SELECT entity_id, 'exact_conservative', cc, name_conservative, 0, 0, 80 FROM qry WHERE name_conservative <> name_normalized AND name_conservative <> ''
  UNION ALL SELECT entity_id, 'sorted_name', cc, array_to_string(list_sort(toks), ' '), 0, 0, 70 FROM qry WHERE len(toks) >= 2
  UNION ALL SELECT entity_id, 'name_bigram', cc, toks[i] || '_' || toks[i + 1], i - 1, 0, 0 FROM (SELECT *, unnest(range(1, least(4, len(toks)))) AS i FROM qry)
  UNION ALL SELECT entity_id, 'name_token', cc, t, i, 1, 0 FROM (SELECT *, toks[i] AS t FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM qry)) WHERE {_NAME}
  UNION ALL SELECT entity_id, 'addr_token', cc, t, i, CASE WHEN {_NUMBER} THEN 2 ELSE 1 END, 0 FROM (SELECT *, atoks[i] AS t FROM (SELECT *, unnest(range(1, len(atoks) + 1)) AS i FROM qry)) WHERE {_ADDRESS}
  UNION ALL SELECT entity_id, 'prefix_6gram', cc, compact[1:6], 0, 0, 8 FROM qry WHERE length(compact) >= 6),
chosen AS MATERIALIZED (SELECT * FROM probes JOIN freq USING (pass, country, key)
  QUALIFY grp = 0 OR row_number() OVER (PARTITION BY s1_id, pass, grp ORDER BY CASE WHEN grp = 1 THEN df ELSE 0 END, pos, key) <= CASE WHEN grp = 1 THEN 3 ELSE 2 END),
hits AS MATERIALIZED (SELECT s1_id, k.entity_id AS cand_id, pass, (CASE pass WHEN 'name_bigram' THEN greatest(25, 65 - {worth}) WHEN 'name_token' THEN greatest(12, 35 - {worth}) WHEN 'addr_token' THEN greatest(15, 40 - {worth}) ELSE base END)::BIGINT AS score
  FROM chosen c JOIN kept k USING (pass, country, key) WHERE df <= {cap})""",
        "pairs": """
pairs AS MATERIALIZED (SELECT s1_id, cand_id, sum(score)::BIGINT AS score, list_sort(list(DISTINCT pass)) AS methods FROM hits GROUP BY s1_id, cand_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, len(methods) DESC, list_contains(methods, 'exact_name')::INT DESC, (list_contains(methods, 'name_bigram') OR list_contains(methods, 'sorted_name'))::INT DESC,
  list_contains(methods, 'name_token')::INT DESC, list_contains(methods, 'addr_token')::INT DESC, cand_id DESC) AS rn, count(*) OVER (PARTITION BY s1_id) AS raw_candidate_count FROM pairs)""",
        "truths": """
truths AS MATERIALIZED (SELECT DISTINCT s1_id, cand_id FROM (SELECT source1_entity_id AS s1_id, trim(unnest(string_split(matched_entity_ids, ','))) AS cand_id FROM truth) WHERE cand_id <> ''),
found AS MATERIALIZED (SELECT t.s1_id, t.cand_id, rn, methods, q.cc AS country FROM truths t JOIN qry q ON q.entity_id = t.s1_id LEFT JOIN ranked r ON r.s1_id = t.s1_id AND r.cand_id = t.cand_id)""",
        "scored": """
scored AS MATERIALIZED (SELECT r.s1_id, r.cand_id, r.score, r.methods, q.cc AS country, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label, least(1.0::DOUBLE, r.score / 150.0::DOUBLE) AS prob
  FROM ranked r JOIN qry q ON q.entity_id = r.s1_id LEFT JOIN truths t ON t.s1_id = r.s1_id AND t.cand_id = r.cand_id WHERE rn <= 50)""",
        "feats": """
two AS MATERIALIZED (SELECT s.s1_id, s.cand_id, s.methods, s.score, a.cc = b.cc AND a.country <> '' AS same_country, a.name_normalized AS na, b.name_normalized AS nb, a.name_conservative AS ka, b.name_conservative AS kb, a.toks AS ta, b.toks AS tb,
  a.compact AS ca, b.compact AS cb, trim(a.name_corporate_suffix) AS sa, trim(b.name_corporate_suffix) AS sb, a.addr_is_empty OR trim(a.addr_normalized) = '' AS ea, b.addr_is_empty OR trim(b.addr_normalized) = '' AS eb,
  a.addr_normalized AS aa, b.addr_normalized AS ab, a.addr_conservative AS ga, b.addr_conservative AS gb, a.atoks AS xa, b.atoks AS xb, list_filter(a.atoks, lambda t: regexp_full_match(t, '\\p{Nd}+')) AS da, list_filter(b.atoks, lambda t: regexp_full_match(t, '\\p{Nd}+')) AS db
  FROM scored s JOIN pre a ON a.entity_id = s.s1_id JOIN pre b ON b.entity_id = s.cand_id)""",
    }


ORDER = ("sources", "pre", "keys", "hits", "pairs", "truths", "scored", "feats")


def chain(upto: str, select: str, more: str = "", **limits) -> str:
    parts = relations(**limits)
    wanted = ORDER[: ORDER.index(upto) + 1]
    return "WITH RECURSIVE " + ",\n".join([*(parts[k].strip() for k in wanted), *([more] if more else [])]) + "\n" + select


def _shared(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct({a} || {b})) ELSE 0.0 END"


def _num(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def feature_select() -> str:
    there = "NOT ea AND NOT eb"
    made = {
        "name_exact_norm": _num("na <> '' AND na = nb"), "name_exact_cons": _num("ka <> '' AND ka = kb"), "name_len_diff": "abs(length(na) - length(nb))::DOUBLE",
        "name_len_ratio": "CASE WHEN greatest(length(na), length(nb)) = 0 THEN 1.0 ELSE least(length(na), length(nb))::DOUBLE / greatest(length(na), length(nb), 1) END",
        "name_shared_tokens_count": _shared("ta", "tb"), "name_token_jaccard": _jaccard("ta", "tb"), "name_sorted_token_equal": _num("len(ta) > 0 AND len(tb) > 0 AND list_sort(ta) = list_sort(tb)"),
        "name_prefix_equal_4": _num("length(ca) >= 4 AND length(cb) >= 4 AND ca[1:4] = cb[1:4]"), "name_prefix_equal_6": _num("length(ca) >= 6 AND length(cb) >= 6 AND ca[1:6] = cb[1:6]"),
        "suffix_both_present": _num("sa <> '' AND sb <> ''"), "suffix_exact_match": _num("sa <> '' AND sa = sb"), "suffix_mismatch": _num("sa <> '' AND sb <> '' AND sa <> sb"), "suffix_either_missing": _num("sa = '' OR sb = ''"),
        "addr_exact_norm": _num(f"{there} AND aa = ab"), "addr_exact_cons": _num(f"{there} AND ga = gb"), "addr_token_jaccard": f"CASE WHEN {there} THEN {_jaccard('xa', 'xb')} ELSE 0.0 END",
        "addr_shared_tokens_count": f"CASE WHEN {there} THEN {_shared('xa', 'xb')} ELSE 0.0 END", "addr_numeric_shared_count": f"CASE WHEN {there} THEN {_shared('da', 'db')} ELSE 0.0 END",
        "addr_numeric_jaccard": f"CASE WHEN {there} THEN {_jaccard('da', 'db')} ELSE 0.0 END", "addr_len_diff": f"CASE WHEN {there} THEN abs(length(aa) - length(ab))::DOUBLE ELSE 0.0 END",
        "addr_s1_empty": _num("ea"), "addr_cand_empty": _num("eb"), "addr_either_empty": _num("ea OR eb"), "addr_both_empty": _num("ea AND eb"), "country_match": _num("same_country"),
        **{f"prov_{p}": _num(f"list_contains(methods, '{p}')") for p in ("exact_name", "exact_conservative", "sorted_name", "name_bigram", "name_token", "addr_token", "prefix_6gram")},
        "prov_num_passes": "len(methods)::DOUBLE", "prov_blocking_score": "least(1.0::DOUBLE, score / 150.0::DOUBLE)",
    }
    return "SELECT s1_id, cand_id, " + ", ".join(f"{v} AS {k}" for k, v in made.items()) + " FROM two"
