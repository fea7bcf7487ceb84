"""op5: SimHash components of all documents."""

from pyspark.sql import functions as F

from . import simhash
from .common import table


def op5_simhash_dedup(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
