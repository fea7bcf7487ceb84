"""op3: quality of all documents by the byte-level network."""

from pyspark.sql import functions as F

from . import quality_cnn, sample
from .common import table

THRESHOLD = 0.3


def fitted(spark, sf_dir):
    """A network fitted on labelled rows whose fold is not 0."""
    rows = sample.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", sample.fold(F.col("doc_id"), 5) != 0, quality_cnn.TRAIN_ROWS)
    return quality_cnn.train(rows)


def op3_quality_cnn(spark, sf_dir):
    scored = quality_cnn.with_score(table(spark, sf_dir, "documents").select("doc_id", "text"), fitted(spark, sf_dir))
    return scored.select("doc_id", (sample.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
