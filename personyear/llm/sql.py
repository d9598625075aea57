"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
item AS (
    SELECT coalesce(item_id, -1) AS item_id,
           regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS words
    FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i)
    WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT r, n, i, list_slice(w, i, i + n - 1) AS words
    FROM doc, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)
),
hits AS (SELECT DISTINCT r, i, p.n, item_id FROM places p JOIN windows v ON v.n = p.n AND v.words = p.words),
words_hit AS (
    SELECT r, count(DISTINCT k) AS n_hit
    FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(i, i + n)) AS t(k)
    GROUP BY r
),
items_hit AS (
    SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM (SELECT DISTINCT r, item_id FROM hits)
    GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""

SEARCH = rf"""
WITH words AS (
    SELECT r, doc_id, unnest(w) AS word
    FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
),
postings AS (SELECT r, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
lengths AS (SELECT r, sum(n) AS length FROM postings GROUP BY r),
statistics AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean),
terms AS (SELECT word, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, statistics GROUP BY word, n_docs),
impacts AS (
    SELECT doc_id, r, word, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean)) AS impact
    FROM postings JOIN lengths USING (r), statistics
),
scored AS (
    SELECT q.doc_id AS query, i.r, i.doc_id, round(sum(q.n * idf * impact), 6) AS score
    FROM postings q JOIN terms USING (word) JOIN impacts i USING (word)
    WHERE q.doc_id % 20 = 0
    GROUP BY ALL
)
SELECT query, doc_id, score, rank
FROM (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 10
"""

_STEPS = ",\n".join(
    f"""best{k} AS MATERIALIZED (
    SELECT h.j, min({{'cost': p.cost + h.length * (h.total - p.total), 'from_j': p.j}}) AS pick
    FROM numbered h JOIN (SELECT j, pick.cost AS cost, total FROM best{k - 1} JOIN sums USING (j)) p ON p.j < h.j
    GROUP BY h.j
    UNION ALL SELECT 0, {{'cost': 0::BIGINT, 'from_j': 0::BIGINT}}
)"""
    for k in range(2, 9)
)

PACKING = f"""
WITH cut AS (
    SELECT doc_id, n, segment::INTEGER AS segment, segment * 4096 AS start, least(4096, n - segment * 4096) AS length
    FROM (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS n FROM documents),
         unnest(range((n - 1) // 4096 + 1)) AS t(segment)
),
histogram AS (SELECT length, count(*)::BIGINT AS n FROM cut GROUP BY length),
numbered AS (
    SELECT row_number() OVER (ORDER BY length) AS j, length, (sum(n) OVER (ORDER BY length))::BIGINT AS total FROM histogram
),
sums AS (SELECT j, total FROM numbered UNION ALL SELECT 0, 0::BIGINT),
best1 AS MATERIALIZED (
    SELECT j, {{'cost': length * total, 'from_j': 0::BIGINT}} AS pick FROM numbered
    UNION ALL SELECT 0, {{'cost': 0::BIGINT, 'from_j': 0::BIGINT}}
),
{_STEPS},
ends AS (SELECT max(j) AS j8 FROM numbered),
chain AS (
    SELECT j8, j7, j6, j5, j4, j3, j2, b2.pick.from_j AS j1 FROM (
    SELECT j8, j7, j6, j5, j4, j3, b3.pick.from_j AS j2 FROM (
    SELECT j8, j7, j6, j5, j4, b4.pick.from_j AS j3 FROM (
    SELECT j8, j7, j6, j5, b5.pick.from_j AS j4 FROM (
    SELECT j8, j7, j6, b6.pick.from_j AS j5 FROM (
    SELECT j8, j7, b7.pick.from_j AS j6 FROM (
    SELECT j8, b8.pick.from_j AS j7 FROM ends JOIN best8 b8 ON b8.j = j8) JOIN best7 b7 ON b7.j = j7)
    JOIN best6 b6 ON b6.j = j6) JOIN best5 b5 ON b5.j = j5) JOIN best4 b4 ON b4.j = j4) JOIN best3 b3 ON b3.j = j3)
    JOIN best2 b2 ON b2.j = j2
),
bounds AS (
    SELECT length AS bucket_length FROM numbered
    WHERE (SELECT max(j) FROM numbered) <= 8
       OR j IN (SELECT unnest([j1, j2, j3, j4, j5, j6, j7, j8]) FROM chain)
),
put AS (SELECT c.*, (SELECT min(bucket_length) FROM bounds WHERE bucket_length >= c.length) AS bucket_length FROM cut c),
ranked AS (
    SELECT *, greatest(1, 65536 // bucket_length) AS per_batch,
           row_number() OVER (
               PARTITION BY bucket_length
               ORDER BY md5(concat_ws(':', doc_id::VARCHAR, segment::VARCHAR)), doc_id, segment, length
           ) - 1 AS place
    FROM put
)
SELECT doc_id, segment, start, length, bucket_length, (place // per_batch)::BIGINT AS batch,
       (place % per_batch)::BIGINT AS slot, bucket_length - length AS padding
FROM ranked
"""

TOOL_CALLS = """
WITH RECURSIVE calls AS (
    SELECT conv_id, turn, 'call_' || turn AS call_id, ['note', 'search', 'translate'][turn % 3 + 1] AS name, text,
           length(text) AS size, CASE WHEN turn > 0 THEN turn // 2 END AS half
    FROM conversations WHERE role = 'assistant'
),
results AS (
    SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text AS output FROM conversations WHERE role = 'user'
),
answers AS (SELECT conv_id, call_id, min({'turn': turn, 'output': output}) AS answer, count(*) AS n FROM results GROUP BY ALL),
levels AS (
    SELECT DISTINCT c.conv_id, c.turn, 0 AS level FROM calls c
    WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.half)
    UNION ALL
    SELECT DISTINCT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.half = l.turn
),
checked AS (
    SELECT c.*, l.level, a.answer, coalesce(a.n, 0) AS n_results,
           CASE WHEN a.answer IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
           CASE WHEN c.half IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.half)
                THEN 'depends_on: unknown call' END AS fault0,
           CASE WHEN name = 'search' AND size < 20 THEN 'query: missing' END AS fault1,
           CASE WHEN name = 'search' AND size % 12 > 10 THEN 'top: beyond maximum' END AS fault2,
           CASE WHEN name = 'search' AND size % 12 < 1 THEN 'top: beyond minimum' END AS fault3,
           CASE WHEN name = 'translate' AND size % 5 = 4 THEN 'target: not listed' END AS fault4
    FROM calls c LEFT JOIN levels l USING (conv_id, turn) LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
),
rows_ AS (
    SELECT conv_id, call_id, turn, name, status, level, concat_ws('; ', fault0, fault1, fault4, fault2, fault3) AS errors, n_results,
           '{"arguments":' || CASE name
               WHEN 'search' THEN CASE WHEN size < 20 THEN '{"top":' || size % 12 || '}'
                                       ELSE '{"query":' || to_json(text) || ',"top":' || size % 12 || '}' END
               WHEN 'translate' THEN '{"target":"' || ['fr', 'es', 'de', 'en', '??'][size % 5 + 1] || '","text":' || to_json(text) || '}'
               ELSE '{"body":' || to_json(text) || ',"pinned":' || (size % 2 = 0) || '}' END
           || ',"depends_on":[' || coalesce('"call_' || half || '"', '') || '],"id":"' || call_id || '","name":"' || name || '"'
           || coalesce(',"result":' || to_json(answer.output), '') || ',"status":"' || status || '"}' AS json,
           level::BIGINT AS rank
    FROM checked
    UNION ALL
    SELECT conv_id, call_id, turn, NULL, 'orphan', NULL, '', 0,
           '{"id":"' || call_id || '","result":' || to_json(output) || ',"status":"orphan"}', 2147483647
    FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
    UNION ALL
    SELECT conv_id, NULL, turn, NULL, 'message', NULL, '', 0,
           '{' || concat_ws(',', '"role":' || to_json(role), '"status":"message"', '"text":' || to_json(text)) || '}', 2147483648
    FROM conversations WHERE coalesce(role NOT IN ('assistant', 'user'), true)
)
SELECT conv_id, call_id, turn, name, status, level, errors, n_results, json,
       row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn, call_id, json) - 1 AS position
FROM rows_
"""

RANKED_SEARCH = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
),
item AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
),
totals AS (SELECT count(DISTINCT r) AS docs, count(*) AS words FROM doc),
lengths AS (SELECT r, 100 - 25 + (25 * count(*) * any_value(docs)) // any_value(words) AS m FROM doc, totals GROUP BY r),
postings AS (SELECT r, doc_id, term, count(*) AS tf FROM doc WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term
),
scored AS (
    SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM item JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r)
    GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""

# crc32 bit by bit: no such function there.  Two words are near if they agree without one letter at the same place, or
# if one is the other without a letter.
SPELLING = r"""
WITH RECURSIVE runs AS (
    SELECT r, run, count(*) AS n, any_value(doc_id) AS doc_id
    FROM (SELECT row_number() OVER () AS r, doc_id,
                 unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]+')) AS run
          FROM documents)
    WHERE length(run) >= 7
    GROUP BY r, run
),
coded AS (
    SELECT run, n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS points FROM runs
),
digests AS (
    SELECT run, n, xor(4294967295, list_reduce(
        [4294967295::BIGINT] || flatten(list_transform(points, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
            lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) AS h
    FROM coded
),
words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
          FROM digests)
    WHERE length(word) >= 7
    GROUP BY word HAVING sum(n) >= 2
),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS hole FROM words, unnest(range(length(word))) AS t(i)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN holes b ON b.hole = a.word
    UNION SELECT b.word, a.word, a.n FROM words a JOIN holes b ON b.hole = a.word
),
near AS (SELECT word, count(*) AS n_near, arg_min({'near': near, 'n': near_n}, {'m': -near_n, 'w': encode(near)}) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * n THEN best.near END AS form, CASE WHEN best.n >= 10 * n THEN best.n END AS form_n
    FROM words LEFT JOIN near USING (word)
),
ends AS (
    SELECT word, word AS place, 0 AS step FROM formed
    UNION ALL SELECT e.word, f.form, step + 1 FROM ends e JOIN formed f ON f.word = e.place WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(place, step) AS root FROM ends GROUP BY word) USING (word)
"""

SQL = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_tool_calls": TOOL_CALLS,
    "op4_search": SEARCH,
    "op5_packing": PACKING,
    "op11_spelling": SPELLING,
    "op13_ranked_search": RANKED_SEARCH,
}
