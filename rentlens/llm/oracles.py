"""Checking SQL of the training-data queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_mix_to_targets"] = r"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS draw
  FROM documents),
g AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, encode(source)) AS k,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER (ORDER BY source_size / w DESC, encode(source) DESC) AS open_w,
    sum(source_size) OVER () AS total
  FROM g),
l AS (SELECT min_by((total - stopped) / open_w, k) AS level FROM r WHERE 3 * source_size >= w * ((total - stopped) / open_w)),
t AS (
  SELECT source, source_size, least(w * coalesce(level, 0), 3 * source_size)::DOUBLE AS target FROM g, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN round(target / source_size, 9) ELSE 0.0 END AS rate FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.rate,
    p.target - floor(p.rate) * p.source_size AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS UNBOUNDED PRECEDING) AS upto, d.size AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate) + (2 * upto - own <= 2 * quota)::INT, 3) * size)::BIGINT AS taken,
  rate, least(floor(rate) + (2 * upto - own <= 2 * quota)::INT, 3)::BIGINT AS copies
FROM c
"""

ORACLES["op7_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
    array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM b, generate_series(1, len(words) - least(len(words), 10) + 1) AS g(i) WHERE len(words) > 0),
ns AS (SELECT DISTINCT n FROM w),
dw AS (
  SELECT row, n, i, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM d, ns, generate_series(1, len(words) - n + 1) AS g(i)),
m AS (SELECT row, dw.n, i, item_id FROM dw JOIN w ON dw.n = w.n AND dw.win = w.win),
h AS (SELECT row, count(DISTINCT p)::BIGINT AS n_hit FROM m, generate_series(i, i + n - 1) AS g(p) GROUP BY row),
it AS (
  SELECT row, count(*)::BIGINT AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN it USING (row)
"""

ORACLES["op10_exact_top_k"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op13_filter_interaction_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    [len(words) < 200,
     100 * len(list_distinct(words)) < 50 * len(words),
     100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o,
    array_to_string(list_transform([a.i, b.i, c.i, d.i, e.i], lambda k: chr((64 + k)::INT)), '') AS filter_order
  FROM x a, x b, x c, x d, x e
  WHERE b.i <> a.i AND c.i NOT IN (a.i, b.i) AND d.i NOT IN (a.i, b.i, c.i) AND e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT filter_order, i AS step, o[i] AS own, o[1 : i - 1] AS earlier FROM o, x),
m AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here,
    len([k FOR k IN earlier IF fails[k]]) > 0 AS gone,
    len([k FOR k IN [1, 2, 3, 4, 5] IF fails[k]]) AS n_fails
  FROM c, s),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND here AND good = 1), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND here AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

ORACLES["op12_hard_negatives"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.row AS a_row, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
    list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.row <> a.row AND len(a.v) = len(c.v)),
p AS (
  SELECT a_row, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
    (row_number() OVER (PARTITION BY p.a_row, place ORDER BY score DESC, s.vec_id))::INT AS rank
  FROM p JOIN s ON s.a_row = p.a_row AND NOT s.same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
