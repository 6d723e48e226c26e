"""DuckDB twins of the queries that SQL can express, written on their own."""

#: Operator 2. Cutoffs are listed again here: 5 rules by 10 cutoffs, strata of 1000 good documents and the rest, alpha 0.01, delta 0.05.
QUALITY_RULES = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         lang,
         coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
positions AS (
  SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS times
  FROM positions),
covered AS (
  SELECT rid, least(5, i - lag(i, 1, -10) OVER (PARTITION BY rid ORDER BY i)) AS new_words FROM windows WHERE times > 1),
repeats AS (SELECT rid, sum(new_words)::BIGINT AS n_repeat_words FROM covered GROUP BY rid),
lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
counted AS (
  SELECT words.rid, doc_id, lang, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, len(list_distinct(w))::BIGINT AS n_distinct
  FROM words JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counted),
known AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
large AS (
  SELECT lang FROM judged JOIN known USING (doc_id) WHERE quality = 1 AND NOT base_failed AND lang IS NOT NULL
  GROUP BY lang HAVING count(*) >= 1000 ORDER BY count(*) DESC, lang LIMIT 64),
based AS (SELECT *, CASE WHEN lang IN (SELECT lang FROM large) THEN lang ELSE 'other' END AS stratum FROM judged),
strata AS (SELECT count(DISTINCT s) AS n_strata FROM (SELECT lang AS s FROM large UNION ALL SELECT 'other')),
ratios AS (
  SELECT rid, stratum, base_failed, quality, unnest([
    {'rule': 'symbols', 'v': n_symbols / greatest(n_words, 1)},
    {'rule': 'dup_lines', 'v': n_dup_lines / greatest(n_lines, 1)},
    {'rule': 'repeats', 'v': n_repeat_words / greatest(n_words, 1)},
    {'rule': 'word_length', 'v': word_chars / greatest(n_words, 1)},
    {'rule': 'same_words', 'v': 1 - n_distinct / greatest(n_words, 1)}], recursive := true)
  FROM based LEFT JOIN known USING (doc_id)),
cutoffs AS (
  SELECT rule, unnest(c) AS cutoff FROM (VALUES
    ('symbols', [0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 2.5]::DOUBLE[]),
    ('dup_lines', [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]),
    ('repeats', [0.05, 0.08, 0.1, 0.12, 0.14, 0.15, 0.16, 0.17, 0.18, 0.19]::DOUBLE[]),
    ('word_length', [5, 6, 7, 8, 9, 10, 12, 15, 20, 30]::DOUBLE[]),
    ('same_words', [0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[])) AS g(rule, c)),
grid AS (
  SELECT stratum, rule, cutoff,
         sum(quality) AS n, sum(1 - quality) AS n_bad,
         sum(quality) FILTER (v > cutoff) AS k, sum(1 - quality) FILTER (v > cutoff) AS k_bad
  FROM ratios JOIN cutoffs USING (rule)
  WHERE quality IS NOT NULL AND NOT base_failed GROUP BY ALL),
filled AS (SELECT stratum, rule, cutoff, n, n_bad, coalesce(k, 0) AS k, coalesce(k_bad, 0) AS k_bad FROM grid),
tails AS (
  SELECT *, CASE WHEN k >= n * 0.002 THEN 1.0 ELSE list_sum(list_transform(range(0, k::BIGINT + 1),
    lambda i: exp(lgamma(n::DOUBLE + 1) - lgamma(i::DOUBLE + 1) - lgamma((n - i)::DOUBLE + 1) + i * ln(0.002) + (n - i) * ln(0.998)))) END AS p
  FROM filled),
admitted AS (
  SELECT stratum, rule, cutoff, k_bad / greatest(n_bad, 1) AS gain FROM tails, strata WHERE p <= 0.05 / (50 * n_strata)),
chosen AS (
  SELECT stratum, rule, cutoff FROM admitted WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
rejected AS (
  SELECT DISTINCT rid FROM ratios JOIN chosen USING (stratum, rule) WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND rejected.rid IS NULL) AS kept
FROM based LEFT JOIN rejected USING (rid)
"""

#: Operator 8.
TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""

#: Operator 10: shingle sets, pairs by shared shingles, and components by a recursive walk.
NEAR_DUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(least.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: Operator 11: units as a list, put together again by form, and taken apart at the markers.
FILL_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
         ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS c2,
         ('0x' || d[17:24])::BIGINT % 100 AS c3, ('0x' || d[25:32])::BIGINT % 100 AS c4
  FROM units),
cut AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 50 THEN 'plain'
              WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(c1, c2)], '') AS pre,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suf
  FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS o
  FROM cut),
taken AS (
  SELECT *, CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN o[4:strpos(o, '<S>') - 1] || o[strpos(o, '<M>') + 3:] || o[strpos(o, '<S>') + 3:strpos(o, '<M>') - 1]
    ELSE o[strpos(o, '<P>') + 3:strpos(o, '<M>') - 1] || o[strpos(o, '<M>') + 3:] || o[4:strpos(o, '<P>') - 1] END AS back
  FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(o) AS output_sha256, sha256(back) AS restored_sha256
FROM taken
"""

#: Operator 12.
HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

#: Operator 13: shares, rates and ranks by ordered running sums instead of rounds.
SOURCE_MIX = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:12])::BIGINT + 0.5::DOUBLE) / (2.0::DOUBLE ^ 48) AS u
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS words,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight
  FROM sized GROUP BY source),
budget AS (SELECT 1.5::DOUBLE * sum(words) AS b FROM weighed),
-- sources by the unit at which they are full; the first one that is not full at the unit of those before fixes it
filling AS (
  SELECT *, coalesce(sum(words) OVER up, 0)::BIGINT AS full_words, (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0))::BIGINT AS open_weight
  FROM weighed WINDOW up AS (ORDER BY words::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
units AS (SELECT *, (b - 2.0::DOUBLE * full_words) / open_weight AS unit FROM filling, budget),
unit AS (SELECT first(unit ORDER BY words::DOUBLE / weight, source NULLS LAST) AS unit FROM units WHERE NOT (2.0::DOUBLE * words < unit * weight)),
targets AS (SELECT source, words, least(2.0::DOUBLE * words, coalesce(unit * weight, 2.0::DOUBLE * words)) AS target FROM weighed, unit),
classes AS (SELECT source, greatest(CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END, 1)::BIGINT AS cls, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
-- importance classes from the top; the first that stays under two copies fixes the rate
rates AS (
  SELECT classes.source, (target - 2.0::DOUBLE * coalesce(sum(classes.words) OVER up, 0)::BIGINT)
           / (sum(cls * classes.words) OVER (PARTITION BY classes.source) - coalesce(sum(cls * classes.words) OVER up, 0))::BIGINT AS rate, cls
  FROM classes JOIN targets ON classes.source IS NOT DISTINCT FROM targets.source
  WINDOW up AS (PARTITION BY classes.source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT source, first(rate ORDER BY cls DESC) AS rate FROM rates WHERE rate * cls <= 2 AND isfinite(rate) GROUP BY source),
expected AS (
  SELECT rid, doc_id, s.source, size, u, words, target, least(2.0::DOUBLE, coalesce(rate * greatest(CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END, 1), 2.0::DOUBLE)) AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN rate r ON s.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT *, floor(e)::BIGINT AS whole, target - sum(floor(e)::BIGINT * size) OVER (PARTITION BY source) AS rest,
         CASE WHEN size > 0 AND e > floor(e) THEN floor((u * (1 - (e - floor(e)))) / ((u * (1 - (e - floor(e)))) + (1 - u) * (e - floor(e))) * (2.0::DOUBLE ^ 48)) END AS rank
  FROM expected),
ordered AS (
  SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, rid) AS up_to FROM drawn)
SELECT doc_id, size, words AS source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND rest > 0 AND (up_to < rest OR (up_to - size < rest AND up_to - rest <= rest - (up_to - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""

ORACLE = {
    "op2_quality_rules": QUALITY_RULES,
    "op8_topk": TOP_K,
    "op10_near_dup": NEAR_DUP,
    "op11_fill_middle": FILL_MIDDLE,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_source_mix": SOURCE_MIX,
}
