"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from lexforge.llm.quality import BLOCKED_WORDS

_W = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS w
  FROM documents),
starts AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM base WHERE len(w) >= 6),
wins AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s FROM starts),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM wins) WHERE n > 1),
steps AS (SELECT rid, least(5, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -10)) AS add_words FROM twice),
rep AS (SELECT rid, sum(add_words) AS n FROM steps GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_distinct_lines,
         len(list_distinct(w)) AS n_distinct_words,
         regexp_matches(text, '(?i)(?:^|[^\p{{L}}])(?:{'|'.join(BLOCKED_WORDS)})(?:$|[^\p{{L}}])')::INT AS has_blocked,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM base LEFT JOIN rep USING (rid)),
d AS (SELECT *, n_lines - n_distinct_lines AS n_dup_lines FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       n_words >= 10 AND n_repeat_words <= n_words / 5.0 AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols <= n_words / 10.0
         AND (n_dup_lines <= 2 OR n_dup_lines <= 0.3 * n_lines) AND n_upper <= 0.3 * word_chars AND n_distinct_words >= sqrt(n_words) AND has_blocked = 0 AS kept
FROM d
"""

#: What follows the first character of the template's control strings.
_TAIL = r"\|(?:turn|end|im_start|im_end|endoftext|system|user|assistant)\|>|\|(?:image|audio|document):[0-9]+\|>|/?s>|</?SYS>>|(?:start|end)_of_turn>|/?INST\]"

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)({_TAIL})', '\1\2\\\3', 'g') AS body,
         replace(replace(regexp_replace(role, '([<\[])(\\*)({_TAIL})', '\1\2\\\3', 'g'), '\', '\b'), chr(10), '\n') AS r
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>' || r || chr(10) || body || '<|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS original, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN n > 1 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
win AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT rid, i, (doc_id, i) > first_value((doc_id, i)) OVER (PARTITION BY h ORDER BY doc_id, i) AS later FROM win),
gone AS (SELECT rid, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM f WHERE later GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce((SELECT string_agg(w[k], ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(g, k)), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS raw FROM d),
c AS (SELECT rid, doc_id, line, raw, row_number() OVER (PARTITION BY rid ORDER BY raw) AS pos FROM u
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT *, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS run FROM c WINDOW w AS (PARTITION BY rid ORDER BY pos)),
f AS (SELECT rid, pos, (doc_id, pos) > first_value((doc_id, pos)) OVER (PARTITION BY run ORDER BY doc_id, pos) AS later FROM win WHERE run IS NOT NULL),
gone AS (SELECT DISTINCT rid, pos + k AS pos FROM f, (VALUES (0), (1), (2)) t(k) WHERE later),
marked AS (SELECT c.rid, c.raw, gone.pos IS NOT NULL AS g FROM c LEFT JOIN gone USING (rid, pos)),
texts AS (
  SELECT u.rid, string_agg(u.line, chr(10) ORDER BY u.raw) FILTER (NOT coalesce(g, false)) AS kept, count(g) AS n_lines, count(*) FILTER (g) AS n_removed
  FROM u LEFT JOIN marked USING (rid, raw) GROUP BY u.rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN texts USING (rid)
"""

EXACT = r"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS FIRST, place)
"""
