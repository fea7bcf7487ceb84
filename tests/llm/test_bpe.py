import base64
import hashlib
from array import array

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pvloss.llm import bpe, bpe_queries
from pvloss.llm.units import UnitStore, units

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tt():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  ", "a  b", " a b ", "a \nb", "\n a", "x\x1c y", "a\xa0 b", "a \xa0b", "it's we'll 'RE", "1²3 ½", "ÀÉ ñandú 中文字 🎉🎉", "\x00 \x00", "a\t\tb \r\n c", "<|endoftext|>", "z" * 70_000, " " * 500 + "q", "é   x"]


def test_pieces_are_their_own_ids():
    own = bpe.codec(PATH, P.PATTERN)
    assert [bytes(own.bytes[a : a + n]) for a, n in zip(own.starts, own.sizes)] == own.tokens
    assert own.model.encode([bpe.as_chars(t) for t in own.tokens], num_threads=1) == [[i] for i in range(len(own.tokens))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sre1² \n\t\xa0\x1cé中.,!_")), max_size=30), max_size=4))
def test_same_as_tiktoken(texts):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    other = test_same_as_tiktoken.__dict__.setdefault("tt", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    own = bpe.codec(PATH, P.PATTERN)
    encoded = own.encode(pa.array(texts, pa.string()))
    assert own.decode(encoded).to_pylist() == [t.encode() for t in texts]
    for t, ids in zip(texts, encoded.to_pylist(), strict=True):
        assert list(array("I", ids)) == other.encode_ordinary(t)
        assert " ".join(units(t)) == t


def test_query_on_odd_texts(spark, tt, tmp_path):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, None, 0), (3, "a  b", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(bpe_queries.op6_byte_bpe(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = [(i, tt.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0]))]
    assert [tuple(r) for r in got] == [(i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()) for i, ids, data in want]


def test_null_ids_decode_to_null():
    own = bpe.codec(PATH, P.PATTERN)
    ids = own.encode(pa.array(["one two", ""]))
    assert own.decode(pa.array([None, ids[0].as_py(), None, b""], pa.binary())).to_pylist() == [None, b"one two", None, b""]


def test_store_stays_bounded():
    def encode(texts, inner):
        texts = [" " * inner + t for t in texts]
        return np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t.encode()) for t in texts])

    store = UnitStore(encode, np.uint8, most=4)
    for texts in [["a b c"], ["a b c d e f", "", " "], ["a " + "y" * 99, "c  d", "x \n y z"], ["g a"], []]:
        values, ends = store.many(pa.array(texts, pa.string()))
        assert [bytes(x).decode() for x in np.split(values, ends[:-1])] == texts if texts else not len(values)
        assert len(store.young.number) <= 2 and len(store.old.number) <= 4 and all(len(u) <= 64 for u in [*store.young.number, *store.old.number])


def test_empty_table(spark):
    assert bpe_queries.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_two_passes_equal_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, None)], "doc_id long, text string")
    two = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    key = lambda r: (r.doc_id is None, r.doc_id)
    one = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert [tuple(r) for r in sorted(two, key=key)] == [tuple(r) for r in sorted(one, key=key)]
