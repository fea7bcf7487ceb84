import math
import re
import zlib

import numpy as np

from pvloss.llm import toxicity, toxicity_queries


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, y, ~y).astype(float) for _ in range(3)]
    noise = (rng.random(4000) < 0.5).astype(float)
    votes = np.stack([*good, noise, noise, noise, noise, noise], 1)  # one voter five times over
    p = toxicity.label_model(votes, 1 / (1 + np.exp(-3 * (np.mean(good, 0) - 0.5))))
    assert ((p > 0.5) == y).mean() > 0.9


def test_query_on_a_fixture(spark, tmp_path):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefghil"), 6)) for _ in range(400)]
    rows = []
    for i in range(800):
        ws = list(rng.choice(vocab, 40))
        if i % 6 == 0:
            ws[int(rng.integers(0, 40))] = "zorp" + str(rng.choice(["en", "ka", "lu", "mi"]))
        rows.append((i, " ".join(ws), "x"))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "fine " * 40_000 + "zorpen", "x"), (None, "idiot", "x"), (0, rows[0][1], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(800)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity_queries.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in got if r.held_out and r.doc_id < 800)
    by = {r.doc_id: r.predicted for r in got}
    assert by[5002] == 1 and by[5000] == by[5001] == 0


def brute_scores(docs, labels):
    """The whole of op10 in plain Python: one loop over documents and traits, matrices by definition."""
    rows = sorted((i, t or "") for i, t in docs if labels.get(i) in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    kinds = {i: labels[i] for i, _ in rows}
    tokens = lambda text: set(re.findall(r"[^\W\d_]+", text.lower()))
    has = lambda text, v: any(w == v[1:] if v[0] == "=" else w.startswith(v[1:]) for w in tokens(text))
    candidates = sorted({v for i, t in rows if kinds[i] for w in tokens(t) for v in ["=" + w, *["^" + w[:k] for k in range(3, 9) if k <= len(w)]]})
    least, ranked = max(5, 0.005 * sum(kinds.values())), []
    for v in candidates:
        toxic = sum(1 for i, t in rows if kinds[i] and has(t, v))
        clean = sum(1 for i, t in rows if not kinds[i] and has(t, v))
        if toxic >= least and toxic >= 0.9 * (toxic + clean + 0.5):
            ranked.append((-round(toxic * math.log((toxic + 1) / (clean + 1)), 9), len(v), v))
    voters = []
    for _, _, v in sorted(ranked):
        if not any(c[0] == "^" and v[1:].startswith(c[1:]) for c in voters):
            voters.append(v)
    voters += ["=" + s for s in toxicity.SEEDS if "=" + s not in voters]

    def votes(text):
        lexicon = [float(has(text, v)) for v in voters]
        return lexicon + [float(bool(re.search(p, text))) for p in toxicity.SHAPES] + [float(not any(lexicon))]

    x = np.array([votes(t) for _, t in rows])
    signed = x.copy()
    signed[:, -1] = -signed[:, -1]
    p = np.array([1 / (1 + math.exp(-3 * ((1.0 if sum(r[: len(voters)]) else 0.0) - 0.5))) for r in x])
    for _ in range(12):
        share, n = min(max(p.mean(), 1e-3), 1 - 1e-3), len(x)
        mean = [sum(q * v for q, v in zip(w, signed)) / max(sum(w), 1e-9) for w in (1 - p, p)]
        cov = sum(w[i] * np.outer(signed[i] - m, signed[i] - m) for w, m in zip((1 - p, p), mean) for i in range(n)) / n
        inverse = np.linalg.inv(cov + 0.02 * np.eye(x.shape[1]))
        log_odds = [float((mean[1] - mean[0]) @ inverse @ (v - (mean[0] + mean[1]) / 2)) + math.log(share / (1 - share)) for v in signed]
        p = np.array([1 / (1 + math.exp(-min(30, max(-30, z)))) for z in log_odds])
    one, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.array([1.0] * x.shape[1] + [1e-6])
    for _ in range(60):  # plain gradient of the same loss, preconditioned by its curvature bound
        q = 1 / (1 + np.exp(-one @ w))
        h = one.T @ (one * (q * (1 - q) + 1e-6)[:, None]) + np.diag(penalty)
        w -= np.linalg.inv(h) @ (one.T @ (q - p) + penalty * w)
    return {i: 1 / (1 + math.exp(-float(np.append(votes(t or ""), 1) @ w))) for i, t in docs}


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(60)]
    docs, labels = [], {}
    for i in range(260):
        ws = list(rng.choice(vocab, 12))
        labels[i] = int(i % 5 == 0)
        if labels[i]:
            ws[3] = str(rng.choice(["zorpen", "Zorpka!!", "idiot", "vlimm", "vlimma"]))
        if rng.random() < 0.2:
            ws[7] = str(rng.choice(["YOUR", "zebra", "##$$", "what??"]))
        docs.append((i, " ".join(ws)))
    docs += [(900, None), (901, ""), (902, "vlimmt you zorpen " * 4000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = brute_scores(docs, labels)
    got = {r.doc_id: r.score for r in toxicity_queries.op10_toxicity(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_voters_have_no_cap(spark):
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(500)) if i % 2 else "nothing", i % 2) for i in range(20)]
    assert len(toxicity.mine(spark.createDataFrame(rows, "doc_id long, text string, label int"))) >= 500


def test_no_labels_and_empty(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, z int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.predicted for r in toxicity_queries.op10_toxicity(spark, str(tmp_path)).collect()] == [0]
    model = toxicity.Model([], np.zeros(len(toxicity.SHAPES) + 1), 0.0)
    assert toxicity.with_score(d.limit(0), model).collect() == [] and toxicity.with_score(d, model).columns == ["doc_id", "text", "z", "score"]
