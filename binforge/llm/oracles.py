"""SQL for the operators that SQL can express: plain joins of all rows, for small tables."""

from __future__ import annotations

from binforge.llm import jaccard, quality, substrings
from binforge.llm.embeddings import COSINE

_WORD = r"[^\x20\x09-\x0D]+"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op4_sql() -> str:
    w = quality.WINDOW
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT r, doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT *, regexp_extract_all(line, '{_WORD}') AS lw FROM l WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM f GROUP BY r),
win AS (SELECT r, i, list_slice(w, i, i + {w - 1}) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {w - 2})) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win JOIN (SELECT r, k FROM win GROUP BY ALL HAVING count(*) > 1) USING (r, k), range({w}) t(j) GROUP BY r),
nl AS (SELECT r, doc_id, host, t, lower(array_to_string(lw, ' ')) AS x, sum(len(lw)) AS words FROM f GROUP BY ALL),
nx AS (SELECT r, doc_id, host, t, regexp_replace(x, '[0-9]+', '0', 'g') AS x, sum(words) AS words FROM nl GROUP BY ALL),
common AS (SELECT host, x, min(doc_id) AS first FROM nx GROUP BY ALL HAVING count(DISTINCT t) > {quality.LINE_LIMIT}),
lost AS (SELECT r, sum(words) AS n FROM nx JOIN common ON nx.x = common.x AND nx.host IS NOT DISTINCT FROM common.host WHERE doc_id IS DISTINCT FROM first GROUP BY r),
b AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS boilerplate_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - boilerplate_words >= {quality.LEAST_WORDS} AND n_words - boilerplate_words >= CAST({quality.LEAST_PART} AS DOUBLE) * n_words AS kept
FROM b
"""


def op6_sql() -> str:
    w = substrings.WIDTH
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT r, doc_id, i, list_slice(w, i, i + {w - 1}) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {w - 2})) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, i + j AS i FROM win JOIN first USING (k), range({w}) t(j) WHERE doc_id > m),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT p.r, count(gone.i) AS n, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS kept FROM p LEFT JOIN gone ON p.r = gone.r AND p.i = gone.i GROUP BY p.r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (r)
"""


def op9_sql() -> str:
    return f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.r AS ra, b.r AS rb FROM f a JOIN f b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {COSINE}
), c AS (SELECT r, r AS t FROM e UNION SELECT c.r, l.rb FROM c JOIN l ON c.t = l.ra),
m AS (SELECT c.r, min(e.vec_id) AS component_id FROM c JOIN e ON c.t = e.r GROUP BY c.r), n AS (SELECT ra AS r, count(*) AS n FROM l GROUP BY ra)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM e JOIN m USING (r) LEFT JOIN n USING (r)
"""


def op10_sql() -> str:
    w = jaccard.WIDTH
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '{_WORD}') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, greatest(len(w) - {w - 2}, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {w - 1}), ' ') AS g FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
j AS (SELECT a.r AS ra, b.r AS rb, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT ra, rb FROM j JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * k >= {jaccard.PERCENT} * (x.n + y.n - k)),
c AS (SELECT r, r AS t FROM d UNION SELECT c.r, l.rb FROM c JOIN l ON c.t = l.ra),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON c.t = d.r GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
