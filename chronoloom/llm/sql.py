"""DuckDB SQL for the queries that SQL can say.

The others (networks, mined rules, templates, codewords, a tokenizer, base 32) are tested against plain versions.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)
),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM placed WHERE k > 1)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op3_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {TERM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {TERM}) AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS g, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op4_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE n > 1) GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n - kinds, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 4 * n_lines OR (t = upper(t) AND t <> lower(t))
    OR (n_words > 0 AND (word_chars > 15 * n_words OR word_chars < 2 * n_words))) AS kept
FROM judged
"""

SQL["op5_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * common.n >= 80 * (sa.n + sb.n - common.n)
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id
"""


def _rounds(n: int) -> str:
    """Assignments a0, a1, ... to centroids c0, c1, ...; each but c0 is made of the assignment before."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, q, c, d FROM (
    SELECT r, vec_id, v.q AS q, c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if i < n:
            out.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c AS c, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % k + k) % k)) // k AS BIGINT) ORDER BY i) AS q
    FROM (SELECT c, i, sum(x) AS s, count(*) AS k FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i)
    GROUP BY c
  ) m ON m.c = c{i}.c
)""")
    return ",\n".join(out)


SQL["op11_centroid_clustering"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT 8)
),
{_rounds(10)}
SELECT vec_id, CAST(a10.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY a10.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c10.q, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON a10.c = c10.c
"""

SQL["op12_conversation_prefix_trie"] = f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(h := h, w := w) ORDER BY turn NULLS FIRST, h) AS ts
  FROM (
    SELECT conv_id, turn, len(regexp_extract_all(t, {WORD})) AS w, sha256(CAST(length(r) AS VARCHAR) || ':' || r || t) AS h
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
  ) GROUP BY conv_id
),
bits AS (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k)
),
crc_table AS (SELECT list(v ORDER BY k) AS v FROM bits),
crc AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, s: xor(c // 256, v[xor(c % 256, s) + 1])), 4294967295) % 4 AS h
  FROM own, crc_table
),
rebuilt AS (
  SELECT own.conv_id AS c, list_concat(coalesce(base.ts[1:h], []), own.ts[h + 1:]) AS ts
  FROM own JOIN crc USING (conv_id) LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 20
),
prefixes AS (
  SELECT c, d, array_to_string(list_transform(ts[1:d], lambda t: t.h), '') AS p, CASE WHEN d > 0 THEN ts[d].w ELSE 0 END AS w, d = len(ts) AS ends
  FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
),
nodes AS MATERIALIZED (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids
  FROM prefixes GROUP BY p, d
),
up AS (SELECT x.*, y.conv_id AS parent FROM nodes x LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = left(x.p, 64 * (x.d - 1))),
kids AS (SELECT left(p, 64 * (d - 1)) AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT v.d, left(u.p, 64 * v.d) AS p, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.w) AS saved
  FROM nodes u LEFT JOIN kids ON kids.p = u.p AND kids.d = u.d, (SELECT DISTINCT d FROM nodes) v WHERE v.d <= u.d GROUP BY ALL
)
SELECT up.conv_id, CAST(up.d AS BIGINT) AS depth, parent AS parent_conv_id, up.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
FROM up LEFT JOIN kids ON kids.p = up.p AND kids.d = up.d JOIN below ON below.p = up.p AND below.d = up.d
"""
