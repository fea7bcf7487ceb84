"""op8: all conversations, formatted and read back."""

from pyspark.sql import functions as F

from . import chat
from .common import table

EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    extra = extra.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    return chat.digest(chat.format_chats(messages))


# Template text outside the bodies: 12 + 1 characters before a text and 11 after it, plus the role.
ORACLE = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(24 + length(replace(replace(replace(role, chr(9243), chr(9243) || 'e'), '<|', chr(9243) || 'l'), chr(10), chr(9243) || 'n'))
                + length(replace(replace(text, chr(9243), chr(9243) || 'e'), '<|', chr(9243) || 'l'))) AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS attachment_tokens
FROM c
"""
