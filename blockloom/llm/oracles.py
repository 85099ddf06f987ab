"""DuckDB SQL that gives the rows of the queries, written from the contracts alone."""

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {}

ORACLE["op1_decontamination"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t='text')}, {_LETTERS}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format(t='text')}, {_LETTERS}) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(ws, k, k + least(10, len(ws)) - 1) AS win FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, n, k, list_slice(ws, k, k + n - 1) AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, sizes)),
hits AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (win)),
words AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits),
c AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

ORACLE["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, k, list_slice(ws, k, k + 12) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
least_id AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN least_id USING (x) WHERE m < doc_id),
g AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) a ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {1 + 10 * part}, 10) AS UBIGINT) >> {35 - 5 * digit}) & 31 AS INTEGER), 1)" for part in range(4) for digit in range(8)
)

ORACLE["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT body, max(page_id) AS ref FROM p GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
CASE WHEN page_id = ref THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = ref THEN NULL ELSE ref END AS refers_to
FROM p JOIN r USING (body)
"""

ORACLE["op5_quality_rules"] = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
tri AS (SELECT doc_id, k, list_slice(ws, k, k + 2) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
twice AS (SELECT doc_id, x FROM tri GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM tri JOIN twice USING (doc_id, x)) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS d, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, {_SPACED}) GROUP BY 1),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(coalesce(l.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines,
length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_n, strlen(regexp_replace(t, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS letters, strlen(t) AS bytes
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (n_symbols > 0.3 * n_words) AND NOT (upper_n > 0.5 * greatest(letters, 1)) AND NOT (letters < 0.3 * greatest(bytes, 1))
AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT (n_dup_lines > 0.5 * n_lines) AS kept
FROM b
"""

_TEMPLATES = """(VALUES ('MIT', 'Released under the MIT License.'), ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
('CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
('BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
('MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'), ('Proprietary', 'All rights reserved.'))"""

ORACLE["op10_license_scan"] = f"""
WITH t AS (SELECT * FROM {_TEMPLATES} v(license, body)),
tw AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(body), '[0-9a-z]+')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, 1 + ln((1 + (SELECT count(*) FROM t)) / (1.0 + count(*))) AS idf FROM tw GROUP BY term),
tn AS (SELECT license, term, tf * idf / sqrt(sum(tf * tf * idf * idf) OVER (PARTITION BY license)) AS w FROM tw JOIN idf USING (term)),
f AS (SELECT doc_id, text, source, lang, coalesce(len(regexp_extract_all(lower(text), '[0-9a-z]+')) <= 40, false) AS lic FROM documents),
p AS (SELECT *, concat_ws('/', source, CASE WHEN lic AND doc_id % 10 = 0 THEN NULL ELSE lang END, CASE WHEN lic AND doc_id % 10 <= 1 THEN NULL ELSE CAST(doc_id // 100 AS VARCHAR) END) AS dir FROM f),
q AS (SELECT doc_id, dir, dir || '/' || CASE WHEN lic THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path FROM p),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM p)),
lw AS (SELECT doc_id, line_no, term, count(*) AS tf FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[0-9a-z]+')) AS term FROM l) GROUP BY ALL),
x AS (SELECT doc_id, line_no, term, tf * coalesce(idf, 1 + ln(1.0 + (SELECT count(*) FROM t))) AS w FROM lw LEFT JOIN idf USING (term)),
n AS (SELECT doc_id, line_no, sqrt(sum(w * w)) AS len FROM x GROUP BY ALL),
c AS (SELECT x.doc_id, license, sum(x.w * tn.w) / any_value(len) AS score FROM x JOIN tn USING (term) JOIN n ON n.doc_id = x.doc_id AND n.line_no = x.line_no GROUP BY x.doc_id, x.line_no, license),
o AS (SELECT doc_id, license AS own_license, s AS own_score FROM (SELECT doc_id, license, round(score, 9) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, license) AS k FROM c WHERE score >= 0.8) WHERE k = 1),
d AS (SELECT dir, own_license AS dir_license FROM (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) AS k FROM p JOIN o USING (doc_id) WHERE lic) WHERE k = 1),
u AS (SELECT doc_id, d.dir, dir_license FROM q JOIN d ON q.path LIKE d.dir || '/%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT q.doc_id, q.path, own_license, own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN u.dir END AS inherited_from
FROM q LEFT JOIN o USING (doc_id) LEFT JOIN u USING (doc_id)
"""

ORACLE["op9_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t='text')}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, k, k + least(4, len(ws)) - 1) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
