"""op7: ids of all documents, written, indexed and read back."""

import public_tokenizers
from pyspark.sql import functions as F

from . import idstore
from .common import table

END_ID = 2


def op7_id_store(spark, sf_dir):
    path = idstore.new_store(spark)
    entries = idstore.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    parts = idstore.part_count(entries)
    idstore.write_index(entries, path, parts)
    found = idstore.read_ids(idstore.lookup(entries, path, parts), path)
    return idstore.with_start(found, entries).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
