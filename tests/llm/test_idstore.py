import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pvloss.llm import idstore, idstore_queries

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", None, "hello  world", "a<|endoftext|> b <|endoftext|>", "<|endoftext|>", " lead", "tail ", "中文 ñ\n\n x", "w " * 30_000, "q" * 20_000]


def test_mph_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    levels = idstore.build_mph(keys)
    assert sorted(idstore.mph_slots(levels, keys).tolist()) == list(range(len(keys)))
    assert idstore.build_mph(keys[:0]) == [] and idstore.mph_slots([], keys[:3]).tolist() == [-1] * 3


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i * 7 % 60, t, i) for i, t in enumerate(TEXTS)] + [(5, "z", 0), (5, "b", 0), (None, "n", 0), (-3, "m", 0)] + [(100 + i, f"text {i}", 0) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = idstore_queries.op7_id_store(spark, str(tmp_path)).collect()
    tok, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_unknown_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(20)], "doc_id long, text string")
    path = idstore.new_store(spark)
    entries = idstore.write_shards(docs, path, PATH, 2, tasks=3)
    assert idstore.write_index(entries, path, 4) == 20
    ask = spark.createDataFrame([(i, 0) for i in range(-50, 25)] + [(3, 1)], "doc_id long, number long")
    assert sorted(r.doc_id for r in idstore.lookup(ask, path, 4).collect()) == list(range(20))
    path = idstore.new_store(spark)
    entries = idstore.write_shards(docs.limit(0), path, PATH, 2)
    assert idstore.write_index(entries, path, 4) == 0 and idstore.lookup(ask, path, 4).count() == 0


def test_one_key_takes_few_bytes_and_shards_roll_over(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " + "x " * (i % 5)) for i in range(3000)] + [(None, "null id"), (7, "text 7 again")] + [(5000 + i, "y " * 1_500_000) for i in range(4)], "doc_id long, text string")
    path = idstore.new_store(spark)
    entries = idstore.write_shards(docs, path, PATH, 2, tasks=2, shard_ids=40)
    monkeypatch.setattr(idstore, "PART_KEYS", 2000)
    parts = idstore.part_count(entries)
    assert parts == 2 and idstore.write_index(entries, path, parts) == 3006
    tok, read = Tokenizer.from_file(PATH), []
    real = idstore.fs.FileSystem.from_uri

    class Counted:
        def __init__(self, where):
            self.where = where

        def get_file_info(self, name):
            return self.where.get_file_info(name)

        def open_input_file(self, name):
            f, outer = self.where.open_input_file(name), self

            class File:
                def read_at(self, n, at):
                    read.append(n)
                    return f.read_at(n, at)

                __enter__, __exit__ = lambda self: self, lambda self, *a: f.close()

            return File()

    monkeypatch.setattr(idstore.fs, "FileSystem", type("FS", (), {"from_uri": staticmethod(lambda uri: (lambda w, n: (Counted(w), n))(*real(uri)))}))
    for key in [(5, 0), (7, 0), (7, 1), (None, 0), (2999, 0)]:
        read.clear()
        text = {(7, 1): "text 7 x x ", (7, 0): "text 7 again", (None, 0): "null id"}.get(key) or f"text {key[0]} " + "x " * (key[0] % 5)
        assert idstore.read_one(path, parts, *key).tolist() == tok.encode(text, add_special_tokens=False).ids + [2]
        assert sum(read) < 1500
    assert idstore.read_one(path, parts, 5, 1) is None and idstore.read_one(path, parts, -9) is None
    assert entries.where("doc_id is not null").select("shard").distinct().count() > 2


def test_one_id_with_a_third_of_all_rows_is_dealt_to_several_tasks(spark):
    rows = [(7, f"same id {i % 500}") for i in range(2000)] + [(None, "no id")] * 900 + [(i, f"own {i}") for i in range(8, 3008)]
    path = idstore.new_store(spark)
    entries = idstore.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, PATH, 2, tasks=8)
    found = entries.collect()
    assert len({r.shard >> idstore.PER_TASK for r in found if r.doc_id == 7}) > 1
    assert sorted(r.number for r in found if r.doc_id == 7) == list(range(2000)) and sorted(r.number for r in found if r.doc_id is None) == list(range(900))
    assert all(r.number == 0 for r in found if (r.doc_id or 0) > 7) and len(found) == len(rows)
    assert idstore.write_index(entries, path, 3) == len(rows) and idstore.lookup(entries, path, 3).count() == len(rows)
