"""DuckDB SQL of the operators that SQL can express, written from their definitions alone.

Line dedup and near-dedup compare contents directly here: windows by their
text, sets by their shingles, components by recursion. Languages, rings,
permutation indexes, tokenizers, packing and fuzzy matches have no SQL; their
tests hold them against brute force.
"""

from __future__ import annotations

from .line_dedup import MIN_WORDS
from .near_dedup import PERCENT, WORDS

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = rf"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS j FROM documents),
units AS (SELECT *, len(regexp_extract_all(line, {_WORD})) AS w, (sum((len(regexp_extract_all(line, {_WORD})) > 0)::INT) OVER (PARTITION BY doc_id ORDER BY j))::BIGINT AS i FROM split),
worded AS (SELECT doc_id, i, w, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS t FROM units WHERE w > 0),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS s FROM worded),
ends AS (SELECT doc_id, i, c, s, max(i) OVER f AS e, max(c) OVER f AS reach, min(i) OVER g AS b, min(s) OVER g AS before FROM sums
  WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 0 FOLLOWING AND {MIN_WORDS - 1} FOLLOWING), g AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND 0 PRECEDING)),
windows AS (SELECT doc_id, i AS b, e FROM ends WHERE reach - s >= {MIN_WORDS} UNION SELECT doc_id, b, i FROM ends WHERE c - before >= {MIN_WORDS}),
content AS (SELECT x.doc_id, x.b, x.e, md5(string_agg(t, chr(10) ORDER BY i)) AS h FROM windows x JOIN worded y ON y.doc_id = x.doc_id AND y.i BETWEEN x.b AND x.e GROUP BY ALL),
firsts AS (SELECT h, min({{'d': doc_id, 'b': b}}) AS f FROM content GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS i FROM content JOIN firsts USING (h) WHERE {{'d': doc_id, 'b': b}} > f),
kept AS (SELECT u.doc_id, string_agg(line, chr(10) ORDER BY j) FILTER (WHERE g.i IS NULL) AS text, count(DISTINCT g.i) AS n FROM units u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM worded x WHERE x.doc_id = d.doc_id), 0) AS n_lines, coalesce(k.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

QUALITY = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS x FROM words WHERE len(w) > 5),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM spots),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k FROM twice, range(5) r(k) WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, {_WORD}) GROUP BY doc_id),
base AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS stutter, length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS upper_ FROM words LEFT JOIN hit h USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (stutter * 10 > 3 * n_words OR n_symbols * 10 > n_words OR n_dup_lines * 2 > len(string_split(text, chr(10))) OR NOT word_chars BETWEEN 2 * n_words AND 16 * n_words OR letters * 2 < word_chars OR upper_ * 2 > letters) AS kept FROM base"""

NEAR = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + {WORDS - 1}], ' ') FOR k IN range(1, len(w) - {WORDS - 2})] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
reach AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT start, b FROM reach JOIN links ON node = a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(node) AS component_id, d.doc_id = min(node) AS kept FROM documents d JOIN reach ON start = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id, z.n"""
