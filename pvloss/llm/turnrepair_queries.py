"""op12: all conversations, damaged by a rule, audited and repaired."""

from pyspark.sql import functions as F

from . import turnrepair
from .common import table


def damaged(rows):
    """rows (conv_id, turn, role, text) with one of five faults by a hash of conversation and turn; most rows stay."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def op12_turn_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(rows)
    found = turnrepair.with_digest(turns, turnrepair.audits(turns, rows.select("conv_id")))
    return found.select("conv_id", *turnrepair.COUNTS, "audit", "repaired_sha256")
