import itertools
import random
import re

import pytest

from pvloss.llm import decontam
from pvloss.llm.decontam import MASKS, SHORT, SLACK, WINDOW


@pytest.mark.parametrize("length, slack", [(WINDOW, SLACK)] + [(n, SLACK - 1) for n in range(SHORT, WINDOW)] + [(n, 0) for n in range(7, SHORT)])
def test_masks_hit_every_window(length, slack):
    for bad in itertools.combinations(range(length), slack):
        assert any(all(m[i] == "0" or s + i not in bad for i in range(len(m))) for m in MASKS for s in range(length - len(m) + 1)), bad


def brute(docs, items):
    toks = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    out = {}
    for d, text in docs:
        h = toks(text)
        for item, itext in items:
            b = toks(itext)
            n = len(b)
            w, need = min(WINDOW, n), WINDOW - SLACK if n >= WINDOW else n - SLACK + 1 if n >= SHORT else n
            for p in range(len(h) - w + 1) if n else []:
                for q in range(n - w + 1):
                    m = sum(x == y for x, y in zip(h[p : p + w], b[q : q + w]))
                    if m >= need:
                        a = out.get((d, item), (0, 10**9, 0))
                        out[d, item] = (max(a[0], m), min(a[1], p), max(a[2], p + w))
    return out


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST", broadcast)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["the", "of"] * 8
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([30, 22, 16, 15, 13, 12, 9, 7, 5, 2, 40])] + [(50, None), (51, " .,"), (0, "alpha beta"), (None, "gamma delta epsilon")]
    docs = [(0, None), (1, ""), (2, "the of " * 20), (3, "x alpha BETA y"), (None, "gamma, delta. epsilon"), (3, "alpha beta")]
    for k in range(60):
        body = rng.choices(words, k=rng.randint(0, 40))
        src = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 5)):
            if src:
                src[rng.randrange(len(src))] = "Q"
        at = rng.randint(0, len(body))
        docs.append((10 + k, ", ".join([*body[:at], *src[rng.randint(0, 2) :], *body[at:]])))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, "z") for i, t in items + items[:3]], "item_id long, text string, doc_id string")
    rows = decontam.leaks(d, b).collect()
    got = {(r.doc_id, r.item_id): (r.matched, r.first_token, r.end_token) for r in rows}
    assert len(rows) == len(got) and got == brute(docs, items)
    left = decontam.without_leaks(d, b)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in {k[0] for k in got})


def test_long_text_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "z " * 60_000 + "one two three four five six seven eight")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    assert decontam.leaks(d, b).count() == 1
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0
