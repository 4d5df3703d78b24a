"""Message tables: from conversations as they are, and a derived view that exercises every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "array<struct<id:string,type:string,name:string,arguments:string>>"

#: Portable SQL (Spark and DuckDB): conversations, documents as tool results with calls, re-reads, near copies, orphans, and
#: templated rows that hold errors, JSON, code, facts, decisions and questions.
VIEW = """
SELECT conv_id, CAST(turn * 1000 AS BIGINT) AS idx, role, text AS content, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS tool_call_id, CAST(NULL AS STRING) AS call_id FROM conversations
UNION ALL SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations), 1 + 2 * CAST(floor(doc_id / (SELECT max(conv_id) + 1 FROM conversations)) AS BIGINT), 'assistant', '', NULL, NULL, 'tc' || CAST(doc_id AS STRING) FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations), 2 + 2 * CAST(floor(doc_id / (SELECT max(conv_id) + 1 FROM conversations)) AS BIGINT), 'tool', text, CASE WHEN doc_id % 3 = 0 THEN 'read_file' WHEN doc_id % 3 = 1 THEN 'search' ELSE 'fetch' END, 'tc' || CAST(doc_id AS STRING), NULL FROM documents WHERE doc_id % 13 <> 0
UNION ALL SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations), 500 + CAST(floor(doc_id / (SELECT max(conv_id) + 1 FROM conversations)) AS BIGINT), 'tool', replace(text, ' ', '  '), CASE WHEN doc_id % 3 = 0 THEN 'read_file' WHEN doc_id % 3 = 1 THEN 'search' ELSE 'fetch' END, 'tr' || CAST(doc_id AS STRING), NULL FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations), 700 + CAST(floor(doc_id / (SELECT max(conv_id) + 1 FROM conversations)) AS BIGINT), 'tool', replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || chr(10) || '-----------' || chr(10) || 'aaaa' || chr(10) || 'test 1 passed' || chr(10) || 'test 2 passed' || chr(10) || 'test 3 passed' || chr(10) || 'test 4 passed' || chr(10) || 'test 5 passed', 'fetch', 'tn' || CAST(doc_id AS STRING), NULL FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT c, 900, 'tool', CASE WHEN c % 4 = 0 THEN 'Traceback (most recent call last):' || chr(10) || '  File "/srv/app/mod_' || CAST(c AS STRING) || '.py", line 12, in run' || chr(10) || '    raise ValueError' || chr(10) || 'ValueError: the value of cell ' || CAST(c AS STRING) || ' is out of range'
  WHEN c % 4 = 1 THEN '[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3, "name": "c"}, {"id": ' || CAST(c AS STRING) || ', "name": "d"}]'
  WHEN c % 4 = 2 THEN 'Here:' || chr(10) || '```' || chr(10) || 'def load_rows(x):' || chr(10) || '    return openFile(x)' || chr(10) || '```'
  ELSE 'Order of 2026-03-1' || CAST(c % 10 AS STRING) || ': total $' || CAST(c AS STRING) || '.50, 12.5% off, see src/app/mod_' || CAST(c AS STRING) || '.py:47 and https://example.com/i/' || CAST(c AS STRING) || ' now' END, 'run', 'tx' || CAST(c AS STRING), NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations) t
UNION ALL SELECT c, 901, 'assistant', 'We looked at src/app/mod_' || CAST(c AS STRING) || '.py first. I''ll use cacheKey for the session store because it is fast. For example the old loader read every row twice and then wrote it back. Maybe we decided to wait.', NULL, NULL, NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations) t
UNION ALL SELECT c, 902, 'user', 'Which approach should the session handler take for storage ' || CAST(c AS STRING) || '?', NULL, NULL, NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations) t
UNION ALL SELECT c, 903, 'assistant', 'Alternatively compare the session handler with plain files.', NULL, NULL, NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations) t
UNION ALL SELECT c, 904, 'assistant', 'Therefore I''ll use session storage in the handler, as established.', NULL, NULL, NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id % 3 <> 0) t
UNION ALL SELECT c, 905, 'assistant', 'Actually mod_' || CAST(c AS STRING) || '.py needs cacheKey (plain) first.', NULL, NULL, NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations) t
UNION ALL SELECT c, 910 + k, 'assistant', CASE WHEN k = 0 THEN ' step done ' WHEN k = 1 THEN 'next one!' WHEN k = 2 THEN '  ' ELSE 'row ' || CAST(c AS STRING) || ' read' END, NULL, NULL, NULL FROM (SELECT DISTINCT conv_id AS c FROM conversations) t, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s
"""


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as messages."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return shaped(c.select("conv_id", F.col("turn").alias("idx"), "role", F.col("text").alias("content")))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived view."""
    c, d = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("conversations", "documents"))
    sql = VIEW.replace("{", "{{").replace("}", "}}").replace("FROM conversations", "FROM {conversations}").replace("FROM documents", "FROM {documents}")
    return shaped(spark.sql(sql, conversations=c, documents=d))


def shaped(df: DataFrame) -> DataFrame:
    """The message columns: conv_id, idx, role, content, name, tool_call_id, tool_calls, metadata, compressed.

    Missing ones are added; null content and roles become empty; ``call_id`` stands for a list of one call.
    """
    have = set(df.columns)
    call = F.when(F.col("call_id").isNotNull(), F.array(F.struct(F.col("call_id").alias("id"), F.lit("function").alias("type"), F.lit("read_file").alias("name"), F.lit("{}").alias("arguments")))) if "call_id" in have else F.lit(None)
    return df.select(
        "conv_id",
        F.col("idx").cast("long").alias("idx"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("content", F.lit("")).alias("content"),
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("name", "tool_call_id")],
        (F.col("tool_calls") if "tool_calls" in have else call).cast(CALLS).alias("tool_calls"),
        (F.col("metadata") if "metadata" in have else F.lit(None)).cast("string").alias("metadata"),
        F.coalesce(F.col("compressed") if "compressed" in have else F.lit(False), F.lit(False)).alias("compressed"),
    )
