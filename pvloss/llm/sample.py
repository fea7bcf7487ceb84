"""Bounded samples of labelled rows, on which classifiers are fitted.

Defined cases: null ids are never picked; an id that is labelled more than once counts once, with its larger label;
labels other than 0 and 1 are no labels; of the rows of a picked id one comes along, whose text is the first by its hash
(null texts are empty ones), so the number of ids bounds that of rows; further columns are dropped; without labels
or documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null ids have fold -1, so no rule holds them out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """doc_id, text, label (0 or 1): one row of docs for each of at most `rows` labelled ids where `keep` (a column over
    doc_id) holds, the first by a hash of the id. The picked ids are broadcast: `rows` bounds them. Rows of
    one id are brought down to one in each task before they are shuffled."""
    picked = labels.where(keep & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return found.groupBy("doc_id", "label").agg(one.alias("one")).select("doc_id", "one.text", "label")
