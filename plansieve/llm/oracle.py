"""DuckDB SQL of the operators that SQL can express: the same definitions, without Spark's plans.

Not here: lattice scores, token counts, byte-level BPE and the classifier (dynamic programs,
merges and descent); they are tested against brute force, public tokenizers, and held-out rows.
"""

from __future__ import annotations

from plansieve.llm import decontam, pii, quality_rules, url_filter

_WORD = r"[^\x20\x09-\x0D]+"

# --- personal data: gaps and matches of a pattern give positions ------------------------------

_BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    "len(dg) BETWEEN 13 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN dg[len(dg) - k + 1]::INT ELSE (dg[len(dg) - k + 1]::INT * 2) // 10 + (dg[len(dg) - k + 1]::INT * 2) % 10 END FOR k IN range(1, len(dg) + 1)]) % 10 = 0"
)


#: each match m of a pattern in a text t, from a to b
_PLACED = (
    "SELECT doc_id, t, m, a, a + length(m) AS b FROM (SELECT doc_id, t, ms[i] AS m, "
    "(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0))::BIGINT AS a FROM "
    "(SELECT doc_id, t, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS ms FROM d), unnest(range(1, len(ms) + 1)) AS u(i))"
)


def _pii() -> str:
    parts = []
    for rank, (kind, pattern) in enumerate(_BASE_PATTERNS.items()):
        check = {
            "email": "true",
            "ip": "list_max([x::HUGEINT FOR x IN string_split(m, '.')]) <= 255",
            "card": _LUHN,
            "phone": "len(dg) BETWEEN 9 AND 15",
        }[kind]
        parts.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, b FROM (SELECT *, string_split({_DIGITS}, '') AS dg FROM ({_PLACED.format(pattern=pattern)})) WHERE {check}")
    near = f"substr(t, greatest(a - {pii.CONTEXT_CHARS}, 0) + 1, least(a, {pii.CONTEXT_CHARS})) || chr(10) || substr(t, b + 1, {pii.CONTEXT_CHARS})"
    moved = "[ord(x) FOR x IN string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')]"
    evidence = {
        "iban": f"list_reduce({moved}, lambda r, c: CASE WHEN c < 65 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END, 0) = 1",
        "ssn": f"NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches({near}, '{pii.near_words('ssn')}')",
        "local_phone": f"regexp_matches({near}, '{pii.near_words('local_phone')}')",
        "secret": f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND regexp_matches({near}, '{pii.near_words('secret')}')",
    }
    for rank, (kind, check) in enumerate(evidence.items(), len(parts)):
        before, after = pii.BORDERS[kind]
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, b FROM ({_PLACED.format(pattern=pii.PATTERNS[kind])}) WHERE NOT (a > 0 AND regexp_matches(substr(t, a, 1), '{before}')) "
            f"AND NOT regexp_matches(substr(t, b + 1, 1), '{after}') AND {check}"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE_PATTERNS)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE_PATTERNS)
    span = "string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY rank, a)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
j AS (SELECT doc_id, {counts}, {span} FILTER (rank < {len(_BASE_PATTERNS)}) AS base, {span} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN j USING (doc_id)"""


# --- quality rules --------------------------------------------------------------------------


def _quality(alpha: float = quality_rules.ALPHA, delta: float = quality_rules.DELTA) -> str:
    ratios = {
        "symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words",
        "same_next": "n_same / n_words", "capitals": "n_capitals / word_chars", "exclaims": "n_exclaims / n_words",
    }
    strict = "greatest(" + ", ".join(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN ({v}) / {quality_rules.REFERENCES[k]!r} ELSE 0 END" for k, v in ratios.items()) + ")"
    levels = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(quality_rules.LEVELS))
    tail = f"list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})) FOR i IN range(k + 1)])"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
c AS (SELECT d.doc_id, stratum, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines, len([1 FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS n_same,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims
  FROM d JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
q AS (SELECT *, {strict} AS s, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT stratum, any_value(s) AS s, max(good) AS good FROM q JOIN marks USING (doc_id) GROUP BY stratum, t),
lv(step, level) AS (VALUES {levels}),
grid AS (SELECT stratum, step, level, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND s > level) AS k, count(*) FILTER (good <> 1 AND s > level) AS caught FROM seen, lv GROUP BY ALL),
ok AS (SELECT *, bool_and({tail} <= {delta} / (SELECT count(DISTINCT stratum) FROM seen)) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM grid),
pick AS (SELECT stratum, max(level) AS level FROM (SELECT *, max(caught) OVER (PARTITION BY stratum) AS most FROM ok WHERE ok) WHERE caught * 100 >= most * {quality_rules.ENOUGH} GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(s <= level, true) AS kept,
  round(s, 9) AS strictness, level FROM q LEFT JOIN pick USING (stratum)"""


# --- decontamination ------------------------------------------------------------------------


def _decontamination() -> str:
    """By all alignments that share a token, without seeds."""
    toks = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '" + _WORD + "')"
    width, share = decontam.WINDOW, decontam.SHARE
    return f"""
WITH d AS (SELECT doc_id, p, w[p] AS tok FROM (SELECT doc_id, {toks} AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(p)),
b AS (SELECT item_id, k, w[k] AS tok, ceil(least(len(w), {width}) * {share}) AS need FROM (SELECT item_id, {toks} AS w FROM benchmark), unnest(range(1, len(w) + 1)) AS u(k)),
al AS (SELECT doc_id, item_id, p - k AS shift, list(k) AS ks, any_value(need) AS need FROM d JOIN b USING (tok) GROUP BY doc_id, item_id, p - k HAVING count(*) >= any_value(need)),
best AS (SELECT doc_id, item_id, need, list_max([len(list_filter(ks, lambda k: k >= a AND k < a + {width})) FOR a IN ks]) AS agreed FROM al)
SELECT doc_id, item_id, max(agreed)::INT AS agreed FROM best WHERE agreed >= need GROUP BY doc_id, item_id"""


# --- similarity join ------------------------------------------------------------------------

_JOIN = f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS t, min(doc_id) AS text_id, count(*) AS n_copies FROM documents GROUP BY coalesce(text, '')),
w AS (SELECT text_id, regexp_extract_all(t, '{_WORD}') AS w FROM t),
sh AS (SELECT DISTINCT text_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
size AS (SELECT text_id, count(*) AS n FROM sh GROUP BY text_id),
both_ AS (SELECT a.text_id AS a, b.text_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.text_id <> b.text_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.text_id = a JOIN size y ON y.text_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT text_id AS a, text_id AS root FROM t UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.a),
cls AS (SELECT a AS text_id, min(root) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS text_id, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, text_id, n_copies, coalesce(deg.n, 0) AS n_links
FROM documents JOIN t ON t.t = coalesce(documents.text, '') JOIN cls USING (text_id) LEFT JOIN deg USING (text_id)"""


# --- sharding -------------------------------------------------------------------------------

_FIT = "list_reduce(range({n}), lambda x, i: coalesce(list_max(list_filter(p, lambda q: q <= x + {cap})), x), 0::BIGINT)"
_SHARDS = f"""
WITH RECURSIVE r AS (SELECT doc_id, text IS NULL AS gone, coalesce(text, '') AS t, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size FROM documents),
g0 AS (SELECT gone, t, CASE WHEN count(*) = count(doc_id) THEN min(doc_id) END AS k, CASE WHEN gone THEN 'null' ELSE sha256(t) END AS dg, sum(size)::BIGINT AS s FROM r GROUP BY gone, t),
g AS (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, dg) - 1 AS at_ FROM g0),
big AS (SELECT at_, s, row_number() OVER w - 1 AS i, sum(s) OVER () - sum(s) OVER w + s AS left_ FROM g WINDOW w AS (ORDER BY s DESC, at_)),
alone AS (SELECT at_, i FROM (SELECT at_, i, bool_and(i < 15 AND s * (16 - i) >= left_) OVER (ORDER BY i) AS ok FROM big) WHERE ok),
parts AS (SELECT 16 - count(*) AS n FROM alone),
keys AS (SELECT at_, s, sum(s) OVER (ORDER BY at_)::BIGINT AS upto FROM g WHERE at_ NOT IN (SELECT at_ FROM alone)),
all_ AS (SELECT list(upto ORDER BY at_) AS p, max(upto) AS total, max(s) AS top FROM keys),
look AS (SELECT greatest(top, (total + n - 1) // n) AS lo, total AS hi FROM all_, parts UNION ALL
  SELECT CASE WHEN full_ THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN full_ THEN (lo + hi) // 2 ELSE hi END
  FROM (SELECT lo, hi, {_FIT.format(n="n", cap="((lo + hi) // 2)")} = total AS full_ FROM look, all_, parts WHERE lo < hi)),
cap AS (SELECT lo FROM look WHERE lo = hi LIMIT 1),
cuts AS (SELECT i, {_FIT.format(n="i", cap="lo")} AS ends FROM unnest(range(1, 16)) AS u(i), cap, all_, parts WHERE i < n),
place AS (SELECT gone, t, coalesce((SELECT i FROM alone WHERE alone.at_ = g.at_), (SELECT 16 - n FROM parts) + (SELECT count(*) FROM cuts, all_ WHERE ends < upto AND ends < total))::INT AS shard
  FROM g LEFT JOIN keys USING (at_)),
tab AS (SELECT [list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) FOR i IN range(256)] AS crc),
hx AS (SELECT DISTINCT t, hex(encode(t)) AS h FROM r),
sums AS (SELECT t, xor(list_reduce([('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)], lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM hx, tab)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM r JOIN place USING (gone, t) JOIN sums USING (t)"""

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op2_pii": _pii(),
    "op5_jaccard_join": _JOIN,
    "op6_decontamination": _decontamination(),
    "op8_quality_rules": _quality(),
    "op10_sharding": _SHARDS,
}
