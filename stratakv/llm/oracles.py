"""DuckDB SQL for the training-data queries that SQL can express whole.

The others (a fitted field, hundreds of rules, fingerprints, packing, spans by patterns) are held
against plain versions in the tests; what the contract fixes of the first two has queries of its own.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_SMALL)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i+2], ' '))) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id AS doc_id, cast(coalesce(max(n.n), 0) AS bigint) AS n_shingles, min(r.y) AS component_id FROM documents d JOIN reach r ON d.doc_id = r.x LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id""",
    "op5_chat_formatting": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('### ' || regexp_replace(role, '([\\<#:])', '\\\1', 'g') || ': ' || regexp_replace(text, '([\\<#])', '\\\1', 'g') || '</turn>' || chr(10)) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, cast(sum(chars) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, cast(octet_length(encode(h)) AS bigint) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(s, (i // 4) * 5 + 1, 5) AS bigint) >> cast(15 - 5 * (i % 4) AS integer)) & 31 AS integer) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM d""",
    "op8_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM win JOIN rep ON win.h = rep.h, range(35) r(j)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id AS doc_id, cast(len(ws) AS bigint) AS n_words, cast(len(ws) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op10_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS k, ls[i] AS line, {_WORDS.format("ls[i]")} AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, k, len(ws) AS n, ws, array_to_string(ws, ' ') AS whole, doc_id * 10000000 + k AS pos FROM l WHERE len(ws) > 0),
c AS (SELECT whole, any_value(ws) AS ws, min(pos) AS pos FROM w GROUP BY 1),
v AS (SELECT whole, pos, i, array_to_string(ws[:i-1] || ws[i+1:], ' ') AS key FROM (SELECT whole, pos, ws, unnest(range(1, len(ws) + 1)) AS i FROM c WHERE len(ws) >= 8)
  UNION ALL SELECT whole, pos, 0, whole FROM c WHERE len(ws) >= 8),
near AS (SELECT a.whole AS whole, min(b.pos) AS pos FROM v a JOIN v b ON a.key = b.key AND a.whole <> b.whole AND (a.i = b.i OR a.i = 0 OR b.i = 0) GROUP BY 1),
r AS (SELECT doc_id, w.k AS k FROM w JOIN c ON w.whole = c.whole LEFT JOIN near ON w.whole = near.whole WHERE w.pos > c.pos OR w.pos > near.pos),
left_ AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS t FROM l ANTI JOIN r USING (doc_id, k) GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n, string_agg(cast(k AS varchar), ',' ORDER BY k) AS ks FROM r GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1)
SELECT d.doc_id AS doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_lines, cast(coalesce(gone.n, 0) AS bigint) AS n_removed, coalesce(ks, '') AS removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN left_ ON d.doc_id = left_.doc_id""",
    "quality_base_counts": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g JOIN twice USING (doc_id, gram), range(3) r(j) GROUP BY 1),
lines AS (SELECT doc_id, count(line) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT w.doc_id AS doc_id, cast(len(ws) AS bigint) AS n_words, cast(length(array_to_string(ws, '')) AS bigint) AS word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  cast(coalesce(lines.n, 0) AS bigint) AS n_dup_lines, cast(coalesce(covered.n, 0) AS bigint) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id LEFT JOIN lines ON w.doc_id = lines.doc_id""",
    "license_base_places": f"""WITH w AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, i, CASE WHEN ws[i:i+1] = ['mit', 'license'] THEN 'mit' WHEN ws[i:i+1] = ['apache', 'license'] THEN 'apache' WHEN ws[i:i+2] = ['general', 'public', 'license'] THEN 'gpl' END AS label
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license'))),
f AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT w.doc_id AS doc_id, cast(len(ws) AS bigint) AS n_words, cast(coalesce(n, 0) AS bigint) AS n_base, cast(a AS bigint) AS first_word, cast(b AS bigint) AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN f ON w.doc_id = f.doc_id""",
    "secret_base_counts": f"""SELECT doc_id, cast(len(list_filter(regexp_extract_all({_SMALL}, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS bigint) AS n_assign,
  cast(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS bigint) AS n_access,
  cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS bigint) AS n_hex FROM documents""",
}
