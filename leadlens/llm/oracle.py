"""DuckDB SQL of the queries that SQL can say over the whole tables."""

from __future__ import annotations

_OP1 = """
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^?#]*)', 1), '') AS rest FROM pages
), p AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM u
), r(h, q, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, r.h || r.q AS rule, r.v, length(r.h || r.q) AS n
  FROM p LEFT JOIN r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.q)
)
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(v, n), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('20240607:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fills FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, (fills, source IS NULL, source)) FROM l WHERE level <= fills) * weight, cap)) AS target
  FROM l
), q AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT *, CASE WHEN target > 0 THEN (pass * source_size + upto) / target ELSE 0 END AS finish
  FROM q CROSS JOIN (VALUES (0), (1)) AS p(pass)
), c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, source NULLS FIRST, doc_id, pass, size ROWS UNBOUNDED PRECEDING) AS words FROM i
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(CASE WHEN words <= (SELECT round(sum(target), 3) FROM t) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM c GROUP BY doc_id, source, size, source_size, target, upto
"""

_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0
), g AS MATERIALIZED (
  SELECT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS gram, count(*) AS n FROM s GROUP BY ALL
), t AS (
  SELECT doc_id, sum(n) AS total FROM g GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b
  WHERE common * 1.0 / (x.total + y.total - common) >= 0.8
), u AS MATERIALIZED (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen
), c AS (
  SELECT id AS doc_id, min(seen) AS class_id FROM r GROUP BY id
)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), l AS MATERIALIZED (
  SELECT doc_id, i - 1 AS line, lines[i] AS content, list_sort(list_distinct(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+'))) AS words,
         len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS n_words
  FROM d, unnest(range(1, len(lines) + 1)) AS x(i)
), s AS MATERIALIZED (
  SELECT words, len(words) AS n, min((doc_id, line)) AS pos FROM l WHERE n_words >= 1 GROUP BY words
), t AS (
  SELECT pos, n, unnest(words) AS word FROM s
), o AS (
  SELECT pos, n, word, count(*) OVER (PARTITION BY word) AS freq FROM t
), p AS MATERIALIZED (
  SELECT pos, n, word FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY freq, word) AS place FROM o)
  WHERE place <= n - ceil(n * 0.8 - 1e-9) + 1
), c AS (
  SELECT DISTINCT a.pos AS late, b.pos AS early FROM p a JOIN p b ON a.word = b.word AND b.pos < a.pos
  WHERE least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 - 1e-9
), v AS (
  SELECT late, x.n AS n, y.n AS m, len(list_intersect(x.words, y.words)) AS k
  FROM c JOIN s x ON x.pos = late JOIN s y ON y.pos = early
), near AS (
  SELECT DISTINCT late AS pos FROM v WHERE k >= (n + m - k) * 0.8 - 1e-9
), kept AS (
  SELECT pos FROM s ANTI JOIN near USING (pos)
), m AS (
  SELECT l.doc_id, l.line, l.content, l.n_words < 1 OR kept.pos IS NOT NULL AS stays
  FROM l LEFT JOIN kept ON kept.pos = (l.doc_id, l.line)
), f AS (
  SELECT doc_id, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (stays), '') AS text, count(*) AS n_lines, count_if(NOT stays) AS n_removed
  FROM m GROUP BY doc_id
)
SELECT doc_id, f.text, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN f USING (doc_id)
"""

_OP7 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), chars AS (
  SELECT doc_id, lang, unnest(regexp_split_to_array(text, '')) AS c FROM d
), class AS MATERIALIZED (
  SELECT doc_id, lang, CASE WHEN regexp_matches(c, '[\x20\x09-\x0D]') THEN 0 WHEN c BETWEEN 'a' AND 'z' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2
           WHEN c BETWEEN '0' AND '9' THEN 3 WHEN contains('.,;:''"-()?', c) THEN 4 WHEN unicode(c) < 128 THEN 5
           WHEN unicode(c) < 640 THEN 6 ELSE 7 END AS class, count(*) AS n
  FROM chars WHERE c <> '' GROUP BY ALL
), bag AS MATERIALIZED (
  SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(words) AS word FROM d) GROUP BY ALL
), size AS (
  SELECT lang, sum(n) AS words FROM bag WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n) >= 2000
  ORDER BY words DESC, lang LIMIT 500
), top AS MATERIALIZED (
  SELECT lang, word, n FROM (SELECT b.lang, word, sum(b.n) AS n FROM bag b JOIN size USING (lang) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 100
), wref AS MATERIALIZED (
  SELECT lang, word, n / words AS q FROM top JOIN size USING (lang)
  UNION ALL SELECT lang, NULL, (words - sum(n)) / words FROM top JOIN size USING (lang) GROUP BY lang, words
), cref AS MATERIALIZED (
  SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM class JOIN size USING (lang) GROUP BY lang, class
), base AS MATERIALIZED (
  SELECT doc_id, lang, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) AS grams
  FROM d
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c
        FROM (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM base)) g, (VALUES (0), (1), (2)) AS o(k)
  WHERE c > 1 GROUP BY doc_id
), counted AS MATERIALIZED (
  SELECT doc_id, lang, n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words
  FROM base LEFT JOIN rep USING (doc_id)
), judged AS MATERIALIZED (
  SELECT doc_id, s.lang AS ref FROM counted, size s WHERE n_words >= 50 AND word_chars >= 200
), total AS (
  SELECT doc_id, sum(n) AS n FROM class GROUP BY doc_id
), cd AS (
  SELECT j.doc_id, ref, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js
  FROM judged j, LATERAL (
    SELECT coalesce(class.n, 0) / total.n AS p, coalesce(r.q, 0) AS q
    FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS k(class) JOIN total ON total.doc_id = j.doc_id
    LEFT JOIN class ON class.doc_id = j.doc_id AND class.class = k.class LEFT JOIN cref r ON r.lang = j.ref AND r.class = k.class) x
  GROUP BY j.doc_id, ref
), seen AS (
  SELECT j.doc_id, j.ref, t.word, b.n FROM judged j JOIN bag b ON b.doc_id = j.doc_id JOIN top t ON t.lang = j.ref AND t.word = b.word
), hist AS (
  SELECT doc_id, ref, word, n FROM seen
  UNION ALL SELECT j.doc_id, j.ref, NULL, c.n_words - coalesce((SELECT sum(n) FROM seen WHERE seen.doc_id = j.doc_id AND seen.ref = j.ref), 0)
  FROM judged j JOIN counted c ON c.doc_id = j.doc_id
), wd AS (
  SELECT j.doc_id, j.ref, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js
  FROM (SELECT j.doc_id, j.ref, w.q, coalesce(h.n, 0) / c.n_words AS p
        FROM judged j JOIN counted c USING (doc_id) JOIN wref w ON w.lang = j.ref
        LEFT JOIN hist h ON h.doc_id = j.doc_id AND h.ref = j.ref AND h.word IS NOT DISTINCT FROM w.word) j
  GROUP BY j.doc_id, j.ref
), near AS (
  SELECT doc_id, bool_or(sqrt(greatest(cd.js, 0)) <= 0.30 AND sqrt(greatest(wd.js, 0)) <= 0.55) AS ok FROM cd JOIN wd USING (doc_id, ref) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(near.ok, true) AS kept
FROM counted LEFT JOIN near USING (doc_id)
"""

SQL: dict[str, str] = {"op1_url_filter": _OP1, "op7_quality_divergence": _OP7, "op8_bag_minhash": _OP8, "op9_fair_mix": _OP9,
                       "op10_line_dedup": _OP10}
