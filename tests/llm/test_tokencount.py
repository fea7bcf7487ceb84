import base64
import random
import re
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from pvloss.llm import tokencount, tokencount_queries
from pvloss.llm.common import stored
from pvloss.llm.tokencount_queries import PRIVATE

PATH = P.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


BITS = ["a", "word", " ", "  ", "\n", "'", "'re", "'l", "l", "12", "é", "中", "!?", " x", "\t ", "\xa0"]


def own_tree(own, text):
    return own.trees(pa.array([text]))[0]


@pytest.mark.parametrize("seed", range(6))
def test_random_edits(monkeypatch, seed):
    monkeypatch.setattr(tokencount, "LEAF", [1, 2, 5, 64][seed % 4])
    own, rng = tokencount.Counter(PATH, P.PATTERN), random.Random(seed)
    for _ in range(150):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 60)))
        tree = own_tree(own, text)
        assert tree.total == len(ENC.encode_ordinary(text))
        for _ in range(6):
            edits, at = [], 0
            for _ in range(rng.choice([1, 1, 2, 5])):
                a = min(len(text), at + rng.choice([0, 1, 2, 9, 40]))
                at = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 30]))
                edits.append((a, at, "".join(rng.choices(BITS, k=rng.choice([0, 1, 2, 8])))))
            want, shift = text, 0
            for a, b, new in edits:
                want = want[: a + shift] + new + want[b + shift :]
                shift += len(new) - (b - a)
            tree, got, _ = own.edit(tokencount.Tree.read(tree.parts()), text, edits)
            assert got == want and tree.total == len(ENC.encode_ordinary(want)), (text, edits)
            tree, text = tree.settled(), got
            again = own_tree(own, text)  # the tree of the new text, but for where leaves begin
            assert [x for i in range(tree.n_leaves) for x in zip(*tree.leaf(i))] == [x for i in range(again.n_leaves) for x in zip(*again.leaf(i))]
            assert tree.total == again.total and tree.chars[1] == len(text) and all(tree.sizes <= 2 * tokencount.LEAF)


def test_only_the_neighbourhood_is_encoded_again_and_leaves_split():
    own = tokencount.Counter(PATH, P.PATTERN)
    text = "some words in a row, " * 5000
    tree = own_tree(own, text)
    tree, after, redone = own.edit(tree, text, [(50_000, 50_003, "zebra")])
    assert redone < 40 and tree.total == len(ENC.encode_ordinary(after)) and len(tree.opened) <= 2
    tree, after, redone = own.edit(tree.settled(), after, [(7, 7, " more" * 3000)])
    assert redone < 3000 * 5 + 40 and tree.settled().sizes.max() <= 2 * tokencount.LEAF and tree.total == len(ENC.encode_ordinary(after))


def test_many_edits_of_one_text_take_linear_time():
    own = tokencount.Counter(PATH, P.PATTERN)
    took = []
    for n in (2000, 16_000):
        text = "id 12345678 " * n
        tree, edits = own_tree(own, text), [(m.start(), m.end(), "[redacted]") for m in re.finditer("[0-9]+", text)]
        began = time.process_time()
        tree, after, _ = own.edit(tree, text, edits)
        took.append(time.process_time() - began)
        assert tree.total == len(ENC.encode_ordinary(after))
    assert took[1] < 24 * took[0] + 0.5


def test_query_against_full_counts(spark, tmp_path):
    texts = [None, "", "no numbers", "ip 10.20.30.40, mail a.b@c.org\nkey " + "ab12" * 8, "1234567", "x" * 60_000 + " 99999999", "é 中 12345678!"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "5555555", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, edits int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in tokencount_queries.op4_token_counts(spark, str(tmp_path)).drop("reencoded_chars").withColumnRenamed("doc_id", "i").na.fill(-1, ["i"]).collect())
    n = lambda t: len(ENC.encode_ordinary(t))
    assert got == sorted((-1 if i is None else i, n(t or ""), len(re.findall(PRIVATE, t or "")), 0, n(re.sub(PRIVATE, "[redacted]", t or ""))) for i, t, _ in rows)


def test_bad_edits_and_kept_trees(spark):
    edits = [(5, 2, "x"), (0, 3, None), (2, 4, "overlap"), (90, 91, "out"), (3, 3, "ins"), None, (None, 1, "n")]
    d = spark.createDataFrame([(1, "hello world", edits), (2, "", [(0, 0, "new text")]), (3, None, None), (None, "again and again", [(5, 5, "!")])], f"doc_id long, text string, edits array<{tokencount.EDIT}>")
    trees = stored(tokencount.build(d, PATH, P.PATTERN), "trees")
    asked = trees.join(d.select("doc_id", "edits"), trees["doc_id"].eqNullSafe(d["doc_id"])).drop(d["doc_id"])
    kept = stored(tokencount.apply_edits(asked, PATH, P.PATTERN, keep=True), "edited")
    got = {r.doc_id: r for r in kept.collect()}
    assert (got[1].text, got[1].n_edits, got[1].n_skipped) == ("inslo world", 2, 3)
    assert got[2].text == "new text" and got[2].n_after == 2 and got[3].n_after == 0 and got[None].text == "again! and again"
    assert all(tokencount.Tree.read(r.tree.asDict()).total == r.n_after == len(ENC.encode_ordinary(r.text)) for r in got.values())
    # A second round of edits starts from the trees that the first one kept.
    second = kept.selectExpr("doc_id", "text", "n_after n_tokens", "tree", "array(named_struct('start', 0L, 'end', 0L, 'replacement', 'oh ')) edits")
    assert all(r.n_after == len(ENC.encode_ordinary(r.text)) for r in tokencount.apply_edits(second, PATH, P.PATTERN, keep=True).collect())
    assert tokencount.apply_edits(tokencount.redactions(tokencount.build(d.limit(0), PATH, P.PATTERN), "x", "y"), PATH, P.PATTERN).count() == 0
