"""SQL for the queries that SQL can express, written apart from the operators.

The weak kinds of the secret scan join by plain ``exists`` here, windows are
compared as texts, and references are counted with window functions.
"""

from __future__ import annotations

from . import quality, secrets

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"

_STRIPS = ["[a-z]+", _BLANK, "[A-Z]+", r"[^\x00-\x7F]+", "[0-9]+", "[-.,;:!?''\"()]+"]


def _strip(level: int) -> str:
    out = "t"
    for p in _STRIPS[:level]:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return out


def _distance(p: str, q: str) -> str:
    a, b = f"list_sum({p})::DOUBLE", f"list_sum({q})::DOUBLE"
    x, y = f"({p}[i] / {a})", f"({q}[i] / {b})"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0.0::DOUBLE END"
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({q}) + 1), lambda i: {part.format(x, y)} + {part.format(y, x)})) / 2, 0)) END"


OP1 = f"""WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{_WORDS}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
 [{", ".join(f"length({_strip(k)})" for k in range(7))}] AS n, {_strip(6)} AS rest FROM base),
counted AS (SELECT *, len(w) AS n_words, list_transform(range(1, 7), lambda k: n[k] - n[k + 1]) || [n[7]] AS c FROM cut),
langs AS (SELECT lang, sum(n_words) AS n, [{", ".join(f"sum(c[{k}])::BIGINT" for k in range(1, 8))}] AS ref_class FROM counted GROUP BY lang HAVING sum(n_words) >= {quality.MIN_REFERENCE}),
words AS (SELECT lang, x AS word, count(*) AS m FROM (SELECT lang, unnest(w) AS x FROM counted) GROUP BY ALL),
top AS (SELECT lang, list(word ORDER BY k) AS words, list(m ORDER BY k) AS ms FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m DESC, word) AS k FROM words) WHERE k <= {quality.COMMON} GROUP BY lang),
refs AS (SELECT lang, ref_class, words, ms || [(n - list_sum(ms))::BIGINT] AS ref_hist FROM langs JOIN top USING (lang)),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, n_words - 3)) AS i FROM counted WHERE n_words >= 5)),
reps AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM wins) WHERE k > 1),
held AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM reps) GROUP BY doc_id),
hist AS (SELECT c.*, r.ref_class, r.ref_hist, list_transform(r.words, lambda x: len(list_filter(c.w, lambda y: y = x))) AS tops FROM counted c LEFT JOIN refs r ON r.lang = c.lang AND c.n_words >= {quality.GUARD_WORDS}),
scored AS (SELECT *, {_distance("c", "ref_class")} AS dc, CASE WHEN ref_hist IS NOT NULL THEN {_distance("(tops || [n_words - list_sum(tops)])", "ref_hist")} END AS dw FROM hist)
SELECT s.doc_id, n_words::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words, n_words < 10 OR 100 * coalesce(h.n, 0) > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * coalesce(h.n, 0) > 20 * n_words OR coalesce(dc, 0) > {quality.MAX_CLASS_DISTANCE} OR coalesce(dw, 0) > {quality.MAX_WORD_DISTANCE}) AS kept
FROM scored s LEFT JOIN held h ON h.doc_id = s.doc_id"""


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, group: int, keep: str) -> str:
    """Matches of one kind with their places; pieces between matches give the places."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, t, {secrets.KINDS.index(kind)} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
 SELECT doc_id, t, ms[i] AS m, gs[i] AS g, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
 SELECT doc_id, t, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
 SELECT doc_id, t, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, string_split_regex(t, {p}) AS ps FROM base))) WHERE {keep}"""


def _near(weak: str, kinds: str) -> str:
    gap = "greatest(a.s, b.s) - least(a.e, b.e)"
    return f"EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.kind IN ({kinds}) AND {gap} <= {secrets.REACH} AND ({gap} <= 0 OR NOT regexp_matches(substring(a.t, (least(a.e, b.e) + 1)::INT, ({gap})::INT), {_quoted(secrets.BREAK)})))"


_IDS, _KEYS = "'access', 'ident'", "'assign', 'hex', 'secret'"
OP2 = f"""WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans("assign", secrets.ASSIGN, 2, "length(g) >= 6")} UNION ALL {_spans("access", secrets.ACCESS, 0, "length(m) >= 20")} UNION ALL {_spans("hex", secrets.HEX, 0, "length(m) >= 24")}
 UNION ALL {_spans("ident", secrets.IDENT, 2, "length(g) >= 4")} UNION ALL {_spans("secret", secrets.SECRET, 0, "length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")} UNION ALL {_spans("endpoint", secrets.ENDPOINT, 0, "true")}),
told AS (SELECT * FROM found a WHERE kind IN ('assign', 'access', 'hex') OR kind = 'ident' AND {_near("a", _KEYS)} OR kind = 'secret' AND {_near("a", _IDS)} OR kind = 'endpoint' AND {_near("a", _IDS)} AND {_near("a", _KEYS)}),
lists AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3), '') AS strong, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans FROM told GROUP BY doc_id)
SELECT base.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(strong, '')) AS base_sha256, coalesce(spans, '') AS spans FROM base LEFT JOIN lists USING (doc_id)"""

_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP6 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, {_ITEM_WORDS}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_AZ.format("coalesce(text, '')")}, {_ITEM_WORDS}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
met AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP8 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM p LEFT JOIN k USING (payload_digest)"""

OP9 = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, least(len(l), 3) AS n, array_to_string(l[i:i + 2], chr(10)) AS win FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM d)),
r AS (SELECT *, row_number() OVER (PARTITION BY n, win ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM r WHERE k > 1)),
x AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT documents.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed, CASE WHEN ps IS NULL THEN sha256(documents.text) ELSE sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(ps, i)), lambda i: l[i]), chr(10)), '')) END AS text_sha256 FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN x USING (doc_id)"""

SQL = {"op1_quality_rules": OP1, "op2_secret_scan": OP2, "op6_decontamination": OP6, "op8_archive_converter": OP8, "op9_line_dedup": OP9}
