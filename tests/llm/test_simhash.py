import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pvloss.llm import simhash, simhash_queries
from pvloss.llm.common import split_by_ids
from pvloss.llm.components import connected_components


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, edges):
    lab = list(range(n))

    def find(a):
        while lab[a] != a:
            a = lab[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        lab[b] = a
    return [find(a) for a in range(n)]


def brute(ids, fps, radius=4):
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    found = roots(len(fps), edges)
    return {i: min(x for x, r in zip(ids, found, strict=True) if r == root) for i, root in zip(ids, found, strict=True)}


def chains(rng, groups, size):
    """Fingerprints in chains: each differs from the one before in 1..4 bits, so ends are far apart."""
    out = []
    for _ in range(groups):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return out


def test_forest_equals_brute_force():
    rng = np.random.default_rng(3)
    fps = np.unique(np.array(chains(rng, 20, 15) + [0, 1, (1 << 64) - 1] + rng.integers(0, 1 << 63, 200).tolist(), np.uint64))
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4])
    edges = simhash.forest(fps, 4)
    assert roots(len(fps), edges) == want and all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in edges)
    assert simhash.forest(fps[:1], 4) == []


@pytest.mark.parametrize("chunk", [8, 1024])
def test_links_keep_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "RUN", 16)
    rng = np.random.default_rng(5)
    fps = sorted(set(chains(rng, 12, 12) + rng.integers(0, 1 << 63, 100).tolist()))
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    got = connected_components(simhash.links(spark.createDataFrame(rows, "fp long, place long").cache()))
    place, got = dict(rows), {r.node: r.root for r in got.collect()}
    want, members = brute(list(range(len(fps))), fps), {}
    for f, i in rows:
        members.setdefault(got.get(f, f), []).append(place[f])
    assert sorted(map(sorted, members.values())) == sorted([i for i, w in want.items() if w == root] for root in set(want.values()))


@pytest.mark.parametrize("n", [1 << 20, 1 << 28, 1 << 40])
def test_band_choices_are_lossless(n):
    bands, agree = simhash.band_choice(n, 4)
    assert bands - 4 >= agree and bands <= 64


def test_query_against_brute_force(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 6
    texts = [None, "", " \n\t", "One two", "one TWO", "one\x0btwo", "É one two three four", base, base.upper(), base + "end", base.replace("fox", "cat", 1), "word " * 9000, "x" * 50_000, base]
    rows = [(i * 3, t, "c", i) for i, t in enumerate(texts)] + [(6, texts[2], "c", 9), (None, base, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash_queries.op5_simhash_dedup(spark, str(tmp_path)).collect()
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    known = brute([i * 3 for i in range(len(texts))], [prints[i * 3] for i in range(len(texts))])
    assert len(got) == len(rows)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id]
        assert r.component_id == known[21 if r.doc_id is None else r.doc_id]


def test_null_ids_take_part_and_common_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    near = lambda k: " ".join([*words[: 400 - k], *[f"x{i}" for i in range(k)]])
    texts = [near(0), near(3), near(6), near(9)]
    prints = [slow_fingerprint(t) for t in texts]
    radius = max((a ^ b).bit_count() for a, b in zip(prints, prints[1:]))
    # Only null ids bear the second and third text: they bridge the first and the last, and take their name.
    rows = [(8, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (None, "quite alone here"), (9, "y"), *[(i, "many rows") for i in range(20, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), slow_fingerprint(t), 5 if t in texts else 20 if t == "many rows" else i) for i, t in rows[:4] + rows[5:])
    for common in (100_000, 10):
        monkeypatch.setattr(simhash, "COMMON", common)
        got = simhash.components(docs, radius=radius).collect()
        assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got if r.component_id is not None) == want
        assert [r.doc_id for r in got if r.component_id is None] == [None]


def test_one_of_each_keeps_one_row_of_every_component(spark):
    a, b, c, d = ("".join(f"{x}{i} " for i in range(60)) for x in "abcd")
    # 5 is repeated: it names the component of text a, and in that of b it gives way to 2.
    rows = [(5, a, "x"), (5, a, "x"), (5, b, "y"), (9, a, "x"), (2, b, "z"), (None, b, "n"), (None, c, "n"), (None, c, "m"), (7, d, None), (8, None, "e"), (3, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = simhash.one_of_each(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", a), ("2", b), ("None", c), ("7", d), ("3", "")])
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_split_by_ids_beyond_the_broadcast(spark):
    docs = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(500)], "doc_id long, text string")
    some = spark.createDataFrame([(i,) for i in range(3, 400, 7)] + [(None,), (3,)], "doc_id long")
    want = sorted((r.doc_id or -1, r.text) for r in docs.collect() if r.doc_id is not None and not (r.doc_id < 400 and r.doc_id % 7 == 3))
    for most, slots in [(1000, 8), (5, 64), (5, 1)]:
        without, of = split_by_ids(docs, some, most=most, slots=slots)
        assert sorted((r.doc_id or -1, r.text) for r in without.collect()) == want and of.count() == 500 - len(want)


def test_empty(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (7, 8), (500, 499)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(300)}, 499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
