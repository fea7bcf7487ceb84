import base64
import hashlib
from array import array

import numpy as np
import public_tokenizers as P
import tiktoken
from test_decontam import brute as leaks
from test_simhash import brute as groups
from test_simhash import slow_fingerprint

import corpus_pipeline
from pvloss.llm import quality_cnn, toxicity


def test_whole_run_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghil"), int(rng.integers(3, 8)))) for _ in range(500)]
    item = " ".join(rng.choice(vocab, 20))
    docs, labels = [], []
    for i in range(360):
        toxic, poor = i % 9 == 0, i % 7 == 0
        ws = list(rng.choice(vocab, 120))
        if toxic:
            ws[10] = "zorp" + ws[10]
        text = " ".join(w + "###$$" for w in ws) if poor else " ".join(ws)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    clean = [i for i in range(360) if i % 9 and i % 7]
    for k in range(5):
        docs.append((1000 + k, docs[clean[k]][1], "en", "s", 1))  # copies
    leaky = [(2000 + k, " ".join([*rng.choice(vocab, 60), item, *rng.choice(vocab, 60)]), None, None, None) for k in range(4)]
    docs += leaky
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [d for d in docs if not (d[0] < 360 and (d[0] % 9 == 0 or d[0] % 7 == 0))]
    named = groups([d[0] for d in left], [slow_fingerprint(d[1]) for d in left])
    left = [d for d in left if named[d[0]] == d[0]]
    bad = {k[0] for k in leaks([d[:2] for d in left], [(0, item)])}
    assert bad == {d[0] for d in leaky}
    want = {d[0]: d[1] for d in left if d[0] not in bad}
    assert set(got) == set(want)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in want.items():
        assert got[i].ids_sha256 == hashlib.sha256(array("I", enc.encode_ordinary(text)).tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert toxicity.TRAIN_ROWS and quality_cnn.TRAIN_ROWS


def test_stages_on_null_ids_repeated_rows_and_more_columns(spark, tmp_path):
    """Nulls in every column, an empty text, a very long one, repeated rows and a column that a stage uses."""
    item = " ".join(f"item{i}" for i in range(20))
    plain = " ".join(f"plain{i}" for i in range(80))
    rows = [(None, plain, None, None, None, 1), (None, plain, "en", "s", 1, 2), (1, None, "en", "s", 1, 3), (2, "", None, "s", None, 4), (3, "lone " * 70_000, "en", "s", 5, 5)]
    rows += [(4, "four " + plain[::-1], "en", "s", 1, 6)] * 2 + [(None, f"null id with {item}", "en", "s", 1, 7), (6, item, "en", "s", 1, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append(docs.count())
    # One class of labels: nobody is rejected. Copies and repeated rows go, then the two texts with the item.
    assert kept == [9, 9, 6, 4]
    got = sorted((str(r.doc_id), r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [("1", False), ("3", True), ("4", True), ("None", True)]
