"""A corpus in five stages: toxic and poor documents go, one document of each group of near copies
stays, documents with benchmark passages go, the rest is encoded.

Each stage takes the documents that the stage before kept and returns the columns of documents; the
last returns the digests of the encoded ids. Classifiers are fitted on labelled rows of the stage's own
input. run() writes every stage to the shared folder and reads it back for the next.

Defined cases: null and empty texts are documents like any other (one near-duplicate group of their own);
rows of a null or repeated id are judged one by one, and the near-duplicate stage keeps one row of each
group; columns other than COLUMNS are dropped; without labels of both classes no document is rejected for
quality, and without labels of toxic ones only fixed words tell; empty tables give no rows.
"""

from pyspark.sql import functions as F

from pvloss.llm import bpe_queries, decontam, quality_cnn, sample, simhash, toxicity
from pvloss.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.3


def not_toxic(spark, docs, sf_dir):
    """Drops documents with a toxicity score of THRESHOLD or more."""
    rows = sample.labelled(docs, table(spark, sf_dir, "labels"), "toxic", sample.fold(F.col("doc_id"), 4) != 2, toxicity.TRAIN_ROWS)
    return toxicity.with_score(docs.select(*COLUMNS), toxicity.train(rows)).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def good_quality(spark, docs, sf_dir):
    """Drops documents with a quality score under THRESHOLD."""
    rows = sample.labelled(docs, table(spark, sf_dir, "labels"), "quality", sample.fold(F.col("doc_id"), 5) != 0, quality_cnn.TRAIN_ROWS)
    return quality_cnn.with_score(docs.select(*COLUMNS), quality_cnn.train(rows)).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Keeps of each SimHash component one row: that of the smallest id, or any where all ids are null."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminated(spark, docs, sf_dir):
    """Drops documents that hold a benchmark passage."""
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    """Encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_queries.digests(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("simhash", near_dedup),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Fitted models and sentencepiece are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
