"""Queries op4, op7 and op9."""

from __future__ import annotations

from tidemark.llm.common import table
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.jaccard_join import similar_documents
from tidemark.llm.line_dedup import drop_boilerplate


def op4_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(spark, table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return drop_boilerplate(table(spark, sf_dir, "documents"), counts=True).select(
        "doc_id", "n_lines", "n_removed", "text")


def op9_benchmark_decontamination(spark, sf_dir):
    return contaminated(spark, table(spark, sf_dir, "documents"),
                        table(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH clean AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
words AS (SELECT doc_id, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM clean),
grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM words),
named AS (SELECT doc_id, g, md5(array_to_string(list_sort(g), '|')) AS node FROM grams),
nodes AS (SELECT node, any_value(g) AS g, min(doc_id) AS rep, count(*) AS copies FROM named GROUP BY node),
gram AS (SELECT node, len(g) AS n, unnest(g) AS s FROM nodes),
pair AS (
  SELECT a.node AS a, b.node AS b FROM gram a JOIN gram b ON a.s = b.s AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n
  HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (
  WITH RECURSIVE r(node, other) AS (
    SELECT node, node FROM nodes
    UNION SELECT r.node, p.b FROM r JOIN pair p ON p.a = r.other)
  SELECT * FROM r),
class AS (
  SELECT r.node, min(n.rep) AS class_id, CAST(sum(n.copies) AS BIGINT) AS class_docs
  FROM reach r JOIN nodes n ON n.node = r.other GROUP BY r.node),
link AS (
  SELECT p.a AS node, CAST(sum(n.copies) AS BIGINT) AS links, count(*) AS node_links
  FROM pair p JOIN nodes n ON n.node = p.b GROUP BY p.a)
SELECT d.doc_id, c.class_id, n.copies - 1 + coalesce(l.links, 0) AS n_links,
       coalesce(l.node_links, 0) AS n_text_links, c.class_docs
FROM named d JOIN nodes n USING (node) JOIN class c USING (node) LEFT JOIN link l USING (node)
"""

OP7_SQL = """
WITH line AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
norm AS (SELECT *, trim(l, ' ') AS k FROM line),
bad AS (
  SELECT k, min(doc_id) AS first_doc FROM norm WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT source) >= 5),
first AS (SELECT doc_id, k, min(pos) AS pos FROM norm GROUP BY doc_id, k),
mark AS (
  SELECT n.doc_id, n.l, n.pos,
         b.k IS NOT NULL AND NOT (b.first_doc = n.doc_id AND f.pos = n.pos) AS gone
  FROM norm n LEFT JOIN bad b USING (k) JOIN first f ON f.doc_id = n.doc_id AND f.k = n.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM mark GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

OP9_SQL = """
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM iw WHERE len(w) >= 5),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM dw WHERE len(w) >= 5),
size AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN i USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""

QUERIES = {f.__name__: f for f in (op4_ngram_jaccard_join, op7_line_dedup,
                                   op9_benchmark_decontamination)}
ORACLE = {"op4_ngram_jaccard_join": OP4_SQL, "op7_line_dedup": OP7_SQL,
          "op9_benchmark_decontamination": OP9_SQL}
