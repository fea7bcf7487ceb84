"""op10: toxicity of all documents."""

from pyspark.sql import functions as F

from . import sample, toxicity
from .common import table

THRESHOLD = 0.3


def fitted(spark, sf_dir):
    """A model fitted on labelled rows whose fold is not 2."""
    rows = sample.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", sample.fold(F.col("doc_id"), 4) != 2, toxicity.TRAIN_ROWS)
    return toxicity.train(rows)


def op10_toxicity(spark, sf_dir):
    scored = toxicity.with_score(table(spark, sf_dir, "documents").select("doc_id", "text"), fitted(spark, sf_dir))
    return scored.select("doc_id", (sample.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
