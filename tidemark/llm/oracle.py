"""The registered queries as SQL for DuckDB, where SQL can say them.

Written from the contracts alone; nothing is imported from the operators.
"""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every 100-byte string by its place; bytes as two hexadecimal digits each.
SUFFIX_DEDUP = """
WITH d AS (
    SELECT doc_id, coalesce(hex(encode(text)), '') AS bytes FROM documents
),
starts AS (
    SELECT doc_id, unnest(range(len(bytes) // 2 - 99)) AS pos, bytes FROM d WHERE len(bytes) >= 200
),
windows AS (
    SELECT doc_id, pos, md5_number(substr(bytes, 2 * pos + 1, 200)) AS w FROM starts
),
again AS (
    SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1
),
edges AS (
    SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM again
),
runs AS (
    SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 100 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos) AS run
    FROM edges
),
spans AS (
    SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS b FROM runs GROUP BY doc_id, run
),
gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL
    SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id
),
kept AS (
    SELECT d.doc_id, string_agg(substr(bytes, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS bytes
    FROM d JOIN gaps USING (doc_id) GROUP BY d.doc_id
),
gone AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.bytes) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.bytes, d.bytes))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

_WORDS = rf"""
words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
)"""

LM_SCORING = f"""
WITH {_WORDS},
grams AS (
    SELECT doc_id, pos, word AS g1,
        CASE WHEN pos > 1 THEN concat_ws(' ', lag(word) OVER p, word) END AS g2,
        CASE WHEN pos > 2 THEN concat_ws(' ', lag(word, 2) OVER p, lag(word) OVER p, word) END AS g3,
        CASE WHEN pos > 1 THEN lag(word) OVER p END AS h2,
        CASE WHEN pos > 2 THEN concat_ws(' ', lag(word, 2) OVER p, lag(word) OVER p) END AS h3
    FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
),
every AS (
    SELECT doc_id, 1 AS n, g1 AS g FROM grams
    UNION ALL SELECT doc_id, 2, g2 FROM grams WHERE g2 IS NOT NULL
    UNION ALL SELECT doc_id, 3, g3 FROM grams WHERE g3 IS NOT NULL
),
own AS (SELECT doc_id, n, g, count(*) AS c FROM every GROUP BY doc_id, n, g),
elsewhere AS (SELECT doc_id, n, g, sum(c) OVER (PARTITION BY n, g) - c AS c FROM own),
sizes AS (SELECT doc_id, count(*) AS n_tokens, sum(count(*)) OVER () - count(*) AS rest FROM words GROUP BY doc_id),
scored AS (
    SELECT t.doc_id,
        CASE WHEN c3.c > 0 THEN ln(c3.c / b3.c)
             WHEN c2.c > 0 THEN ln(c2.c / b2.c) + CASE WHEN t.pos > 2 THEN ln(0.4) ELSE 0 END
             ELSE ln(greatest(c1.c, 1) / greatest(s.rest, 1)) + ln(0.4) * (least(t.pos, 3) - 1 + CASE WHEN c1.c > 0 THEN 0 ELSE 1 END)
        END AS score,
        CASE WHEN c3.c > 0 THEN 0
             WHEN c2.c > 0 THEN CASE WHEN t.pos > 2 THEN 1 ELSE 0 END
             ELSE least(t.pos, 3) - 1 + CASE WHEN c1.c > 0 THEN 0 ELSE 1 END
        END AS backoffs
    FROM grams t
    JOIN sizes s ON s.doc_id = t.doc_id
    JOIN elsewhere c1 ON c1.doc_id = t.doc_id AND c1.n = 1 AND c1.g = t.g1
    LEFT JOIN elsewhere c2 ON c2.doc_id = t.doc_id AND c2.n = 2 AND c2.g = t.g2
    LEFT JOIN elsewhere b2 ON b2.doc_id = t.doc_id AND b2.n = 1 AND b2.g = t.h2
    LEFT JOIN elsewhere c3 ON c3.doc_id = t.doc_id AND c3.n = 3 AND c3.g = t.g3
    LEFT JOIN elsewhere b3 ON b3.doc_id = t.doc_id AND b3.n = 2 AND b3.g = t.h3
),
summed AS (SELECT doc_id, sum(score) AS score, sum(backoffs) AS backoffs FROM scored GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n_tokens, 0) AS BIGINT) AS n_tokens, round(m.score, 4) AS log_score,
    CAST(coalesce(m.backoffs, 0) AS BIGINT) AS n_backoffs, round(m.score / s.n_tokens, 4) AS mean_log_score
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN summed m ON m.doc_id = d.doc_id
"""

DECONTAMINATION = rf"""
WITH {_WORDS},
items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
texts AS (SELECT doc_id, list(word ORDER BY pos) AS w FROM words GROUP BY doc_id),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, p.n, i, item FROM places p JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
met AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
),
counts AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE lists AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM lists WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
),
least_of AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

EXACT_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

#: The table of CRC-32 by its polynomial; sequences of turns as lists of (role, text).
CONVERSATION_TRIE = """
WITH crc AS (
    SELECT list(e ORDER BY n) AS entry FROM (
        SELECT n, list_reduce(
            [n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
        ) AS e
        FROM range(256) t(n)
    )
),
own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
sized AS (
    SELECT conv_id, s, xor(4294967295, list_reduce(
        [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
        lambda c, b: xor(c >> 8, entry[xor(c, b) % 256 + 1])
    )) % 9 AS h
    FROM own, crc
),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s
    FROM sized c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
),
ways AS (
    SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM rebuilt
),
members AS (
    SELECT conv_id, depth, s[1:depth] AS node, len(s) = depth AS ends FROM ways
),
nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
        CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(node[depth].text) END AS saved
    FROM members GROUP BY node, depth
),
children AS (
    SELECT node[1:depth - 1] AS parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
),
counted AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children ON children.parent = nodes.node
),
up AS (
    SELECT node, depth, saved, n_children, unnest(range(depth + 1)) AS d FROM counted
),
trees AS (
    SELECT node[1:d] AS top, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, t.n_leaves,
    CAST(t.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN trees t ON t.top = c.node LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[1:c.depth - 1]
"""

SQL = {
    "op1_suffix_array_dedup": SUFFIX_DEDUP,
    "op2_lm_scoring": LM_SCORING,
    "op3_decontamination": DECONTAMINATION,
    "op6_ngram_jaccard_join": JACCARD_JOIN,
    "op8_exact_topk": EXACT_TOPK,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
