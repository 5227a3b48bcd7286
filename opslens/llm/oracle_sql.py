"""DuckDB SQL for those training-data queries that SQL can express."""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
size AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang),
phrases AS (
  SELECT lang, w[i:i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, p, f AS a FROM phrases WHERE len(p) > 1),
inner_parts AS (
  SELECT lang, p[i:i + k - 1] AS p, max(a) AS within
  FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM cand, (SELECT unnest([2, 3, 4]) AS k) WHERE k < len(p))
  GROUP BY ALL),
free AS (
  SELECT c.* FROM cand c LEFT JOIN inner_parts i ON c.lang = i.lang AND c.p = i.p
  WHERE i.within IS NULL OR 100 * i.within < 100 * c.a),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM free),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, s.n,
         (1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN size s ON s.lang = c.lang
  JOIN phrases x ON x.lang = c.lang AND x.p = c.p[1:c.k]
  JOIN phrases y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""

#: crc32 bit by bit; the repair as a table over rows and states, one row a step
CONVERSATIONS = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (
  SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''),
             lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT)) % 20 AS kind
  FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         left(role, 1) AS c, regexp_extract_all(text, '[^\x20\x09-\x0D]') AS solid
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN len(solid) = 0 THEN 1 WHEN nth > 1 THEN 2 WHEN solid[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
moves AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(s, c, t)),
inserts AS (
  SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
                        (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')) t(s, t, cost, letters)),
edits AS (
  SELECT f.conv_id, f.i, e.s, e.t, e.cost, e.letter FROM faults f, LATERAL (
    SELECT s, s AS t, 4 AS cost, 'D' AS letter FROM (VALUES (0), (1), (2), (3)) d(s)
    UNION ALL
    SELECT m.s, m.t, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END, 'K' FROM moves m WHERE m.c = f.c AND f.fault IN (0, 3)
    UNION ALL
    SELECT r.s, r.t, CASE WHEN f.fault = 3 THEN 6 ELSE 3 END, 'R' FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) r(s, t) WHERE f.fault IN (0, 3)) e),
steps AS (
  SELECT e.conv_id, e.i, n.s, e.t, min(n.cost + e.cost) AS cost,
         arg_min(n.letters || e.letter, ((n.cost + e.cost), n.letters || e.letter)) AS letters
  FROM edits e JOIN inserts n ON n.t = e.s GROUP BY ALL),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, t, cost, audit FROM (
    SELECT w.conv_id, e.i, e.t, w.cost + e.cost AS cost, w.audit || e.letters AS audit,
           row_number() OVER (PARTITION BY w.conv_id, e.t ORDER BY w.cost + e.cost, w.audit || e.letters) AS k
    FROM walk w JOIN steps e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.s = w.s) WHERE k = 1),
ends AS (
  SELECT w.conv_id, w.cost + n.cost AS cost, w.audit || n.letters AS audit
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.s = w.s AND n.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.cost, w.audit || n.letters) = 1),
letters AS (
  SELECT conv_id, k, audit[k] AS letter, sum(CASE WHEN audit[k] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM ends)),
kept AS (
  SELECT l.conv_id, l.k, l.letter, f.role, f.text, f.c, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS place
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
led AS (
  SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM kept),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS repaired FROM led GROUP BY conv_id)
SELECT d.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(s.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
"""

#: pairs by the shingles they share, the rarer ones of each set first
JACCARD = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM split),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
ranked AS (
  SELECT doc_id, n, e, row_number() OVER (PARTITION BY doc_id ORDER BY f, e) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY e) AS f FROM elements)),
prefix AS (SELECT doc_id, n, e FROM ranked WHERE k <= n - (90 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.e = b.e AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 90 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id FROM sets s JOIN low l ON l.doc_id = s.doc_id
"""
