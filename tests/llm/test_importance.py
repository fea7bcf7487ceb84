import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pvloss.llm import importance, importance_queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, percent=5, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for rows, n in ((docs, s), (target, t)):
        for _, text in rows:
            for b in slow_features(text)[1]:
                n[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        words, features = slow_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_pieces_make_the_same_features(most):
    text = "Ab c-D Éa_b 12x\x00 " * 9 + "ünder" * 30 + " K. K ok " + "z"
    found = [(n, h) for n, h in importance.hashes(text.encode(), most)]
    words, features = slow_features(text)
    assert sum(n for n, _ in found) == words and sorted(int(x) % 10_000 for _, h in found for x in h) == sorted(features)
    for short in ("", " ;", "one", "one two", "one two three"):
        assert sorted(int(x) % 10_000 for _, h in importance.hashes(short.encode(), most) for x in h) == sorted(slow_features(short)[1])


@pytest.mark.parametrize("accuracy", [10_000, 2])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, accuracy):
    common = "alpha beta gamma delta one two three four five six seven eight nine ten eleven twelve a b c d e f "
    docs = [(i, common * (1 + i % 4) + f"word{i} x{i * i} É{i % 7}") for i in range(300)]
    docs += [(400, None), (401, ""), (402, " .;"), (403, "Short text"), (404, "long " * 400_000), (None, common * 2), (None, common * 2), (7, docs[7][1]), (7, common), (405, "w " * 20), (406, "w " * 19)]
    target = [(1, "alpha beta gamma delta"), (2, None), (3, "word3 x9 É3 " * 5), (3, "word3 x9 É3 " * 5)]
    spark.createDataFrame([(i, t, "k", 1.0, None) for i, t in docs], "doc_id long, text string, rank string, score double, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(importance.bracket, "__defaults__", (accuracy,))
    resample = importance.resample
    monkeypatch.setattr(importance, "resample", lambda d, t: resample(d, t, accuracy=accuracy))
    got = importance_queries.op11_importance(spark, str(tmp_path))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)


def test_ties_few_rows_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(5, text, "a")] * 50 + [(6, text, "b")] * 50, "doc_id long, text string, extra string")
    target = spark.createDataFrame([("one two",)], "text string")
    got = importance.resample(docs, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len({r.doc_id for r in got if r["rank"]}) == 1 and {r.extra for r in got} == {"a", "b"}
    assert [r["rank"] for r in importance.resample(docs.limit(19), target).collect()] == [None] * 19
    assert importance.resample(docs.limit(0), target.limit(0)).collect() == []
    assert importance.resample(docs.limit(3), target.limit(0)).agg(F.count("weight")).first()[0] == 3
    with pytest.raises(ValueError):
        importance.resample(docs.withColumn("rank", F.lit(1)), target)
