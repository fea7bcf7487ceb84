"""op2: quality rules on all documents."""

from . import quality_lm
from .common import table


def op2_quality_rules(spark, sf_dir):
    return quality_lm.rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
