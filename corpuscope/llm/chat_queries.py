"""Query of the chat formatter and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions.steps import pinned
from corpuscope.llm import chat

PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark, sf):
    """All conversations, and one whose texts are control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text"))
    done = chat.format_chats(turns.unionByName(probe))
    done = pinned(done, {"turns": chat.read_turns(F.col("formatted")), "learned": chat.loss_text(F.col("segments"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for s in ("<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "[ROLE]"):
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens
  FROM turns),
sized AS (
  SELECT *, length({_escaped('text')}) + CASE WHEN opens THEN
      length({_escaped('role')}) + 13 + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END ELSE 6 END AS chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": SQL}
