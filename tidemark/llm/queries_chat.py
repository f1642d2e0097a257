"""Query op1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.chat_format import (
    format_paths, linear_messages, loss_text, read_turns, reply_paths,
)
from tidemark.llm.common import materialize, table

PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  given.schema)
    paths = reply_paths(spark, linear_messages(given.unionByName(probe)))
    made = materialize(spark, format_paths(paths), "formatted")
    turn = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return (made.withColumn("turns", read_turns(F.col("formatted")))
            .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
            .select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("turns", turn), ""), 256)
                    .alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
made AS (
  SELECT *, CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 18 WHEN 'assistant' THEN 10 ELSE
    24 + length(regexp_replace(role, '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\]))', '\\\1', 'g')) END
    + length(regexp_replace(text, '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\]))', '\\\1', 'g')) AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (op1_chat_format,)}
ORACLE = {"op1_chat_format": OP1_SQL}
