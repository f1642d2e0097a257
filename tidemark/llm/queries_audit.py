"""Queries op11 and op13."""

from __future__ import annotations

from tidemark.llm.common import table
from tidemark.llm.filter_audit import audit_filters
from tidemark.llm.importance import resample


def op11_filter_interaction_audit(spark, sf_dir):
    return audit_filters(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark, sf_dir):
    return resample(spark, table(spark, sf_dir, "documents"),
                    table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = """
WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM base),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
doc AS (
  SELECT c.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN c.doc_id > min(c.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM cut c LEFT JOIN told l ON l.doc_id = c.doc_id),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
filter_order AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
step AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS done
         FROM filter_order, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
judged AS (
  SELECT d.part, d.good, d.toxic, s.o, s.s, s.f, d.fails = s.f AS alone,
         contains(d.fails, s.f) AS hit,
         EXISTS (SELECT 1 FROM letter l WHERE contains(s.done, l.f) AND contains(d.fails, l.f)) AS gone
  FROM doc d, step s),
counted AS (
  SELECT part, o, s, f, count(*) FILTER (WHERE NOT hit AND NOT gone) AS kept,
    count(*) FILTER (WHERE hit AND NOT gone) AS removed,
    count(*) FILTER (WHERE hit AND gone) AS redundant,
    count(*) FILTER (WHERE alone) AS unique_fails,
    count(*) FILTER (WHERE hit AND NOT gone AND good) AS good_lost,
    count(*) FILTER (WHERE hit AND NOT gone AND toxic) AS toxic_lost
  FROM judged GROUP BY part, o, s, f)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, kept, removed, redundant, unique_fails,
       good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

# crc32 by its definition: 8 shifts per byte of the feature, on distinct features
OP13_SQL = """
WITH word AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
gram AS (
  SELECT side, id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
  FROM word),
octet AS (
  SELECT list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS v, i
  FROM (SELECT unnest(range(0, 256)) AS i)),
lookup AS (SELECT list(v ORDER BY i) AS v FROM octet),
distinct_gram AS (SELECT DISTINCT g FROM gram),
summed AS (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(range(1, octet_length(encode(g)) + 1),
                   lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i - 1, 2) AS BIGINT))),
    lambda c, x: xor(c // 256, v[xor(c % 256, x) + 1]))) % 10000 AS b
  FROM distinct_gram, lookup),
hit AS (SELECT side, id, b, count(*) AS n FROM gram JOIN summed USING (g) GROUP BY side, id, b),
bucket AS (
  SELECT b, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s,
         coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM hit GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM bucket),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS v
         FROM bucket, total),
weight AS (SELECT id, CAST(sum(n * v) AS BIGINT) AS weight FROM hit JOIN gain USING (b)
           WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words,
    CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features,
    coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM word LEFT JOIN weight USING (id) WHERE side = 'd'),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS draw
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= draw THEN r END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op11_filter_interaction_audit, op13_importance_resampling)}
ORACLE = {"op11_filter_interaction_audit": OP11_SQL, "op13_importance_resampling": OP13_SQL}
