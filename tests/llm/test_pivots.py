import duckdb
import numpy as np
import pytest

from pvloss.llm import pivots, pivots_queries


def mates(rng, base, cosine):
    """Vectors at an angle of that cosine."""
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return cosine * base + np.sqrt(1 - cosine**2) * noise


def slow(rows, least=0.95):
    """Every pair, row by row."""
    good = [(k, np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, label = [0] * len(rows), list(range(len(rows)))
    for x, (i, a) in enumerate(good):
        for j, b in good[:x]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                if label[i] != label[j]:
                    old, new = label[i], label[j]
                    label = [new if y == old else y for y in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((i, n[k], component, i is not None and i == component))
    return sorted(out, key=str)


def fixture():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    hot = mates(rng, np.repeat(base[:1], 80, axis=0), 0.985)  # one large group of near copies, not all of them linked
    near = np.vstack([mates(rng, base[1:40], c) for c in (0.99, 0.97, 0.958)])
    vectors = [*base.tolist(), *hot.tolist(), *near.tolist(), *(3.0 * base[5:9]).tolist(), *base[:3].tolist(), *base[:3].tolist()]
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 32, [float("nan"), *[1.0] * 31], [float("inf"), *[1.0] * 31], [None, *[1.0] * 31], [1.0] * 5, [2.0] * 5, [1e100] * 5, [-1.0] * 5, [1.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    return [*rows, *[(900 + i, v) for i, v in enumerate(odd)], (None, base[7].tolist()), (None, [7.0] * 9), (900, base[11].tolist()), (4, base[50].tolist())]


@pytest.mark.parametrize("chunk,common", [(1024, 100_000), (16, 2)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, chunk, common):
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    monkeypatch.setattr(pivots, "RUN", 50)
    monkeypatch.setattr(pivots, "COMMON", common)
    monkeypatch.setattr(pivots, "NEAREST", 12)  # every pair meets
    rows = fixture()
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = pivots_queries.op13_pivot_index(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == slow(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(pivots_queries.ORACLE).fetchall(), key=str) == got


def test_recall_and_no_false_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.vstack([base, mates(rng, base, 0.9501), mates(rng, base[:700], 0.97)]).astype(np.float32)
    got = {r.vec_id: r for r in pivots.linked(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    true = (y @ y.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() > 2000


def test_large_group_of_near_copies_counts_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.vstack([base, mates(rng, np.repeat(base[:1], 400, axis=0), 0.999)])
    got = pivots.linked(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))
    assert {r.component_id for r in got if r.n_links} == {0}


def test_empty_and_counts(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.linked(none).collect() == []
    assert [pivots.pivot_count(n) for n in (0, 1, 4000, 5000, 60_000, 10**12)] == [64, 64, 64, 128, 256, 4096]
