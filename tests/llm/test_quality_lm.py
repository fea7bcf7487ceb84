import re
from collections import Counter

import numpy as np
import pytest

from pvloss.llm import quality_lm, quality_lm_queries


def slow_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if triples[tuple(words[i : i + 3])] > 1}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


class Plain:
    """Modified Kneser-Ney over the bytes of texts, with dictionaries and one recursion."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        self.marked = [["^", *t] for t in texts]
        for t in self.marked:
            for end in range(1, len(t)):
                k = min(order, end + 1)
                self.count[k][tuple(t[end + 1 - k : end + 1])] += 1
        for k in range(order - 1, 0, -1):
            left = Counter(g[1:] for g in self.count[k + 1])
            self.count[k] = Counter({g: n for g, n in self.count[k].items() if g[0] == "^"}) + left
        self.total, self.kinds, self.cuts = [], [], []
        for c in self.count:
            total, kinds, of = Counter(), {}, [max(1, sum(1 for n in c.values() if n == i)) for i in range(1, 5)]
            for g, n in c.items():
                total[g[:-1]] += n
                kinds.setdefault(g[:-1], Counter())[min(n, 3)] += 1
            y = of[0] / (of[0] + 2 * of[1])
            raw = [i - (i + 1) * y * of[i] / of[i - 1] for i in (1, 2, 3)]
            self.total.append(total)
            self.kinds.append(kinds)
            self.cuts.append([0.0] + [min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.9, 2.8))])

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        below = self.p(gram[1:])
        total = self.total[k][gram[:-1]]
        if not total:
            return below
        n, d = self.count[k][gram], self.cuts[k]
        return max(n - d[min(n, 3)], 0) / total + sum(d[i] * c for i, c in self.kinds[k][gram[:-1]].items()) / total * below

    def log_ppl(self, text):
        t = ["^", *text]
        logs = [np.log(self.p(tuple(t[max(0, e + 1 - self.order) : e + 1]))) for e in range(1, len(t))]
        return -sum(logs) / len(logs) if logs else None


def running(text):
    return b" ".join((text or "").encode().split())


def mixed_texts(n):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdeé\x00"), int(rng.integers(1, 7)))) for _ in range(60)]
    return [" ".join(rng.choice(vocab, int(rng.integers(1, 60)))) for _ in range(n)] + [None, " ", "a", "\x00\x00b", "ab cd ef", "ef cd ab"]


def test_plain_model_sums_to_one():
    m = Plain([running(t) for t in mixed_texts(20)], quality_lm.ORDER)
    for context in [("^",), ("^", 97), tuple(b"ab ab"), tuple(b"zzzzz"), tuple("é a".encode())]:
        assert sum(m.p((*context, b)) for b in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("in_task", [1 << 24, 0])
def test_perplexity_against_plain_model(spark, monkeypatch, in_task):
    texts = mixed_texts(80)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    want = Plain([running(t) for t in texts], quality_lm.ORDER)
    got = {r.doc_id: r.log_ppl for r in quality_lm.scored(docs, in_task).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (pytest.approx(want.log_ppl(running(t)), abs=1e-8) if running(t) else None)
    assert got[len(texts) - 2] != pytest.approx(got[len(texts) - 1], abs=1e-3)  # the order of words matters


def test_same_verdicts_by_both_ways(spark):
    docs = spark.createDataFrame([(i, (t or "") + " " + " ".join(str(k * i % 97) for k in range(60)), ["en", "de", None][i % 3], "x") for i, t in enumerate(mixed_texts(90))], "doc_id long, text string, lang string, chunk string")
    mapped, joined = quality_lm.rules(docs).collect(), quality_lm.rules(docs, in_task=5).collect()
    assert sorted(map(tuple, mapped)) == sorted(map(tuple, joined)) and len(mapped) == 96


def test_bands_follow_one_rule(spark, monkeypatch):
    """Copies count once, few documents are all inside, an outlier of a large language is not."""
    rows = [("a", 2.0 + i / 1000, i) for i in range(100)] + [("a", 2.05, 200 + i) for i in range(900)] + [("a", 9.0, 5000), ("a", 0.5, 5001), ("b", 1.0, 5002), ("b", 8.0, 5003), ("c", 3.0, 5004)]
    scored = spark.createDataFrame([(i, lang, 60, 0, 0, 0, 0, p) for lang, p, i in rows], f"doc_id long, {quality_lm.RESULT}")
    monkeypatch.setattr(quality_lm, "scored", lambda docs, in_task: scored)
    assert {r.doc_id for r in quality_lm.rules(scored).where("not kept").collect()} == {5000, 5001}


def test_percentiles_are_exact_beyond_any_sketch(spark):
    rng = np.random.default_rng(6)
    rows = [(lang, float(x)) for lang, n in (("en", 20_000), ("de", 7), ("", 1)) for x in rng.permutation(n) / 3]
    got = {r.lang: (r.v0, r.v1, r.v2) for r in quality_lm.percentiles(spark.createDataFrame(rows, "lang string, log_ppl double"), "lang", "log_ppl", (0.1, 0.5, 0.9)).collect()}
    for lang in ("en", "de", ""):
        values = sorted(x for k, x in rows if k == lang)
        assert got[lang] == tuple(values[max(1, int(np.ceil(len(values) * q))) - 1] for q in (0.1, 0.5, 0.9))


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("abcde"), int(rng.integers(2, 7)))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(40, 120)))), ["en", "de", None][i % 3], "x") for i in range(300)]
    rows += [(1000, None, "en", "x"), (1001, " \n\t", "en", "x"), (1002, "a b c\n a b c\na b c\n\n\n", None, "x"), (1003, "same line here\n" * 60, "fr", "x"), (1004, "w " * 50_000, "en", "x"), (1005, "é\xa0x\x1cy\x85z | # <b>", "en", "x")]
    rows += [(1006, " ".join("QXZ#" + w.upper() + "&&@" for w in rng.choice(vocab, 100)), "en", "x"), (3, rows[3][1], "en", "x"), (None, rows[4][1], "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_lm_queries.op2_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[1006] and np.mean([kept[i] for i in range(300) if slow_counts(texts[i])[0] >= 50]) > 0.97


def test_empty(spark):
    assert quality_lm.rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    only = spark.createDataFrame([(1, None, None), (2, " ", "en")], "doc_id long, text string, lang string")
    assert [(r.kept, r.log_ppl) for r in quality_lm.rules(only).collect()] == [(False, None)] * 2
