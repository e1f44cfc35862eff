"""DuckDB SQL for the queries that SQL can express.

The others use hash functions, tokenizers or learned models that DuckDB lacks;
``tests/llm`` holds them against brute force and held-out labels.
"""

_WINDOWS_OF_WORDS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS s, words FROM w WHERE len(words) >= 50
), named AS (
  SELECT doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS name FROM win
), least AS (
  SELECT name, min(doc_id) AS first_id FROM named GROUP BY name
), hit AS (
  SELECT DISTINCT n.doc_id, unnest(range(n.s, n.s + 50)) AS p
  FROM named n JOIN least l ON n.name = l.name AND l.first_id < n.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM hit GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(w.words) AS n_words,
         list_filter(w.words, lambda x, i: NOT coalesce(list_contains(g.places, i), false)) AS words
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(words) AS BIGINT) AS n_removed,
       sha256(array_to_string(words, ' ')) AS kept_sha256
FROM kept
"""

_STRINGS_OF_BYTES = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS s, h FROM d WHERE length(h) >= 200
), named AS (
  SELECT doc_id, s, md5(substring(h, CAST(2 * s + 1 AS BIGINT), 200)) AS name FROM win
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY name ORDER BY doc_id, s) AS k FROM named
), hit AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM ranked WHERE k > 1
), run AS (
  SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM hit
), span AS (
  SELECT doc_id, r, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY doc_id, r
), spans AS (
  SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM span GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, d.h, coalesce(p.n_removed, 0) AS n_removed, coalesce(p.n_spans, 0) AS n_spans,
         CASE WHEN p.doc_id IS NULL THEN d.h ELSE
           array_to_string(list_transform(range(0, len(p.starts) + 1), lambda i:
             substring(d.h, CAST(2 * coalesce(p.ends[i], 0) + 1 AS BIGINT),
                       CAST(2 * (coalesce(p.starts[i + 1], length(d.h) // 2) - coalesce(p.ends[i], 0)) AS BIGINT))), '') END AS k
  FROM d LEFT JOIN spans p ON d.doc_id = p.doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM kept
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i : i + size - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS size) AS sizes
), f AS MATERIALIZED (
  SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL
), total AS (
  SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang
), candidate AS MATERIALIZED (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE size > 1 AND a >= 10
), sides AS (
  SELECT lang, phrase, a, 1 AS k, v[1] AS first_part, array_to_string(v[2 : size], ' ') AS rest FROM candidate
  UNION ALL
  SELECT lang, phrase, a, 2 AS k, array_to_string(v[1 : 2], ' ') AS first_part, v[3] AS rest FROM candidate WHERE size = 3
), with_left AS MATERIALIZED (
  SELECT c.*, l.a AS l FROM sides c JOIN f l ON l.lang = c.lang AND l.phrase = c.first_part
), cut AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.a, c.k, c.l, r.a AS r, 1000000 * c.a * c.a // (c.l * r.a) AS score
  FROM with_left c JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cut
), longer AS (
  SELECT lang, array_to_string(v[1 : 2], ' ') AS phrase, a FROM candidate WHERE size = 3
  UNION ALL
  SELECT lang, array_to_string(v[2 : 3], ' ') AS phrase, a FROM candidate WHERE size = 3
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidate c JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE c.size = 2 AND 100 * o.a >= 50 * c.a
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s ANTI JOIN gone g ON g.lang = s.lang AND g.phrase = s.phrase WHERE place = 1
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op12_phrases": _PHRASES, "op2_suffix_dedup": _STRINGS_OF_BYTES, "op10_substring_dedup": _WINDOWS_OF_WORDS}
