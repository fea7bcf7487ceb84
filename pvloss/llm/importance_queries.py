"""op11: all documents weighed towards the benchmark's distribution."""

from . import importance
from .common import table


def op11_importance(spark, sf_dir):
    found = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
