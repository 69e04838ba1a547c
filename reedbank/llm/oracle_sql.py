"""DuckDB SQL of the operators that SQL can express at the size that it is run on."""

from reedbank.llm.op05_chat import OP5_SQL
from reedbank.llm.op09_secrets import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5
      UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[p:p+least(10, len(w))-1], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p) WHERE len(w) > 0),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p+size-1], ' ') AS s FROM d, (SELECT DISTINCT size FROM win), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS p)),
hit AS (SELECT doc_id, p, size, item FROM dw JOIN win USING (size, s)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, LATERAL (SELECT unnest(range(p, p + size)) AS q) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

OP6_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, {_WORD}) AS w, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS c FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM p, LATERAL (SELECT unnest(range(i, i + 5)) AS q) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT doc_id, x, w, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS m, len(string_split(x, chr(10))) AS lines FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR NOT word_chars / m BETWEEN 2.0 AND 20.0 OR n_symbols / m > 0.3 OR (n_dup_lines >= 4 AND n_dup_lines > 0.5 * len(l))
    OR length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) < 0.5 * word_chars OR coalesce(list_max(list_transform(w, lambda v: length(v))), 0) > 1000
    OR len(regexp_extract_all(x, '(?m)^\s*[-*•]')) > 0.9 * lines OR len(regexp_extract_all(x, '(?m)(\.\.\.|…)\s*$')) > 0.3 * lines) AS kept
FROM b
"""

OP8_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, b[i:i+99] AS w FROM b, LATERAL (SELECT unnest(range(1, octet_length(b) - 98)) AS i)),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
isle AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, (i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 100)::INT AS new FROM dup)),
span AS (SELECT doc_id, min(i) AS s, max(i) + 99 AS e FROM isle GROUP BY doc_id, k),
piece AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) + 1 AS f FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s + 1) AS n_removed, max(e) AS last, string_agg(CASE WHEN s > f THEN hex(b[f:s-1]) ELSE '' END, '' ORDER BY s) AS head FROM piece JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE unhex(head || CASE WHEN last < octet_length(b) THEN hex(b[last+1:octet_length(b)]) ELSE '' END) END) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)
"""


def _secrets() -> str:
    parts = []
    for place, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, list_transform(string_split_regex(x, '{p}'), lambda v: length(v)) AS gaps,
  list_transform(regexp_extract_all(x, '{p}'), lambda v: length(v)) AS hits, list_transform(regexp_extract_all(x, '{p}', {group}), lambda v: length(v)) AS ms, {least} AS least FROM t WHERE regexp_matches(x, '{p}')"""
        )
    union = "\nUNION ALL ".join(parts)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS ({union}),
s AS (SELECT doc_id, place, kind, (list_sum(gaps[1:k]) + coalesce(list_sum(hits[1:k-1]), 0))::BIGINT AS s, hits[k] AS n FROM m, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS k) WHERE ms[k] >= least),
g AS (SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) AS spans, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) FILTER (place <= 2) AS base FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""


OP9_SQL = _secrets()

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS s FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
  ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, x, len(u) AS n, u, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, x, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""

#: The unsigned CRC-32 of an ASCII string.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)), 4294967295)"""

OP12_SQL = f"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, count(*) AS n, c - c % 5 AS b, {_CRC32.format("c::VARCHAR")} % 9 AS h FROM o GROUP BY c
), r AS (
  SELECT k.c, p, role, x FROM k JOIN o ON o.c = k.b AND p <= h
  UNION ALL SELECT k.c, p - k.h + least(k.h, coalesce(b.n, 0)), role, x FROM o JOIN k ON k.c = o.c AND p > k.h LEFT JOIN k b ON b.c = k.b
), m AS (
  SELECT c, p AS d, md5(string_agg(md5(length(role) || ':' || role || x), '') OVER (PARTITION BY c ORDER BY p)) AS k, octet_length(encode(x)) AS bytes FROM r
  UNION ALL SELECT c, 0, '', 0 FROM k
), n AS (
  SELECT d, k, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM m GROUP BY d, k
), u AS (
  SELECT n.*, a.c AS up, a.k AS up_k FROM n LEFT JOIN m ON m.c = n.c AND m.d = n.d - 1 LEFT JOIN n a ON a.d = m.d AND a.k = m.k
), v AS (
  SELECT up_k AS k, d - 1 AS d, count(*) AS children FROM u WHERE d > 0 GROUP BY up_k, d
), w AS (
  SELECT u.*, coalesce(children, 0) AS children FROM u LEFT JOIN v ON v.k = u.k AND v.d = u.d
), s AS (
  SELECT m.d, m.k, sum((w.n - 1) * w.bytes) AS saved, count(*) FILTER (w.children = 0) AS leaves FROM w JOIN m ON m.c = w.c AND m.d <= w.d GROUP BY m.d, m.k
), e AS (
  SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM m) WHERE d = last GROUP BY d, k
)
SELECT w.c AS conv_id, w.d AS depth, w.up AS parent_conv_id, w.n AS n_convs, w.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s ON s.d = w.d AND s.k = w.k LEFT JOIN e ON e.d = w.d AND e.k = w.k
"""

ORACLE_SQL = {
    "op1_ngram_join": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_chat": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op9_secrets": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
