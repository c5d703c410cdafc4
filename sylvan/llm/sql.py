"""DuckDB statements for the queries that SQL can express."""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT rid, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35
), k AS (
  SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM k
), g AS (
  SELECT rid, list(DISTINCT j) AS gone FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM c WHERE n > 1) GROUP BY rid
), o AS (
  SELECT rid, unnest(range(1, len(ws) + 1)) AS j, ws FROM d
), x AS (
  SELECT o.rid, string_agg(o.ws[o.j], ' ' ORDER BY o.j) AS kept
  FROM o LEFT JOIN (SELECT rid, unnest(gone) AS j FROM g) r ON o.rid = r.rid AND o.j = r.j
  WHERE r.j IS NULL GROUP BY o.rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN x USING (rid)
"""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT rid, doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d WHERE length(h) >= 100
), k AS (
  SELECT rid, doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS m FROM p
), c AS (
  SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY m) AS dup FROM k
), s AS (
  SELECT rid, i, i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 AS apart FROM c WHERE dup
), r AS (
  SELECT rid, i, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM s
), runs AS (
  SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY rid, run
), gaps AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS was FROM runs
), kept AS (
  SELECT g.rid, string_agg(substr(d.h, 2 * g.was + 1, 2 * (g.a - g.was)), '' ORDER BY g.a) AS head, max(g.b) AS last,
         sum(g.b - g.a) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN d USING (rid) GROUP BY g.rid
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.head || substr(d.h, 2 * k.last + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (rid)
"""

ORACLES = {"op4_suffix_array_dedup": OP4, "op9_substring_dedup": OP9}

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s
), k AS (
  SELECT *, row_number() OVER o AS k, CAST(cap AS DOUBLE) / w AS ratio,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, k) FROM k WHERE level <= ratio) * w) AS target FROM k
), b AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, target - whole * source_size AS rest FROM b
), leaf AS (
  SELECT source, substr(h, 1, 9) AS p, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY ALL
), c AS (
  SELECT source, p, n, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM leaf
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST((r.whole + CASE WHEN c.before < r.rest AND (c.before + c.n <= r.rest OR 2 * (r.rest - c.before) >= c.n) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND substr(d.h, 1, 9) = c.p
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), p AS (
  SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p
), r AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN r USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END)
         + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END) AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, CAST(failures AS BIGINT) AS failures,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept,
       CASE failures WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
         WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' WHEN 64 THEN 'shouting' END AS only_rule
FROM f
"""

OP10 = r"""
WITH i AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), ig AS (
  SELECT DISTINCT iid, item_id, least(5, len(ws)) AS m, array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)
), n AS (
  SELECT iid, count(*) AS n FROM ig GROUP BY iid
), dg AS (
  SELECT DISTINCT rid, doc_id, m, array_to_string(ws[k:k + m - 1], ' ') AS g
  FROM (SELECT d.*, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM ig) WHERE len(ws) >= m)
)
SELECT dg.doc_id, ig.item_id, CAST(n.n AS BIGINT) AS n_shingles, count(*) AS n_found, count(*) / n.n AS containment
FROM dg JOIN ig USING (m, g) JOIN n USING (iid)
GROUP BY dg.rid, dg.doc_id, ig.iid, ig.item_id, n.n HAVING 5 * count(*) >= 4 * n.n
"""

ORACLES |= {"op3_source_mixing": OP3, "op6_quality_rules": OP6, "op10_benchmark_decontamination": OP10}
