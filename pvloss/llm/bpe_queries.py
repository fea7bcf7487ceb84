"""op6: all documents through the byte-level BPE and back."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe
from .common import table


def digests(docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
