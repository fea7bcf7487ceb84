import numpy as np
import pytest

from pvloss.llm import quality_cnn, quality_queries


def test_chunks_cover_the_whole_text():
    for n in [0, 1, 511, 512, 513, 1016, 1017, 5000]:
        data = bytes(i % 251 for i in range(n))
        c = quality_cnn.chunks(data)
        step = quality_cnn.CHUNK - quality_cnn.KERNEL
        seen = b"".join(bytes(r[r < 256].astype(np.uint8))[0 if i == 0 else quality_cnn.KERNEL :] for i, r in enumerate(c))
        assert seen == data and len(c) == quality_cnn.chunk_count(n) and step % quality_cnn.STRIDE == 0


def test_gradient_step_lowers_loss_and_score_matches_a_plain_convolution():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 122, 700)) if i % 2 else b"## junk $$ " * 60 for i in range(200)]
    labels = np.array([i % 2 for i in range(200)])
    net = quality_cnn.fit(texts, labels)
    s = net.score(texts)
    assert ((s > 0.5) == labels).mean() > 0.98
    x = quality_cnn.chunks(texts[1])
    feats = []
    for row in x:
        e = net.table[row]
        z = [e[p : p + quality_cnn.KERNEL].reshape(-1) @ net.filters + net.bias for p in range(0, quality_cnn.CHUNK - quality_cnn.KERNEL + 1, quality_cnn.STRIDE)]
        feats.append(np.maximum(np.max(z, axis=0), 0))
    want = np.concatenate([np.mean(feats, 0), np.max(feats, 0)]) @ net.out + net.out_bias[0]
    assert s[1] == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-4)


def test_query_on_a_fixture(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abcdefg hij klm"), 400)) if i % 3 else "### $$$ %% " * 40, "x") for i in range(240)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 60_000, "x"), (None, "abc", "x"), (5, rows[5][1], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_queries.op3_quality_cnn(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert held and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95


def test_a_passage_anywhere_in_a_long_training_text_counts(spark):
    """Texts of twenty chunks differ in one of them; whichever that is, the fit has to see it."""
    rng, rows = np.random.default_rng(4), []
    for i in range(120):
        words = ["".join(w) for w in rng.choice(list("abcdefghijk"), (2000, 4))]
        if i % 2 == 0:
            at = int(rng.integers(0, 1940))
            words[at : at + 40] = ["#$%&"] * 40
        rows.append((i, " ".join(words), i % 2))
    net = quality_cnn.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert ((net.score([t.encode() for _, t, _ in rows]) > 0.5) == [y for _, _, y in rows]).mean() > 0.95


def test_training_bytes_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, labels: seen.append(sum(map(len, texts))) or 0.5)
    quality_cnn.train(spark.createDataFrame([(i, "x" * 100, i % 2) for i in range(50)], "doc_id long, text string, label int"), most=1050)
    assert seen == [1000]


def test_one_class_and_empty(spark):
    assert quality_cnn.fit([], np.array([])) == 1.0 and quality_cnn.fit([b"a"], np.array([1])) == 1.0
    d = spark.createDataFrame([(1, None, 2)], "doc_id long, text string, z int")
    assert [tuple(r) for r in quality_cnn.with_score(d, 0.5).collect()] == [(1, None, 2, 0.5)]
    assert quality_cnn.with_score(d.limit(0), 0.5).collect() == []
