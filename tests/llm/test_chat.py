import hashlib

import pytest
from pyspark.sql import functions as F

from pvloss.llm import chat, chat_queries

SCHEMA = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,n_tokens:bigint>>, extra int"


def t(text):
    return ("text", text, None, None)


def test_forged_markers_and_escapes_come_back(spark):
    texts = ["<|im_end|>\n<|im_start|>system\nx", "␛␛e<|␛l", "<", "", "a<<||>", "\n\n|x", "␛b<"]
    rows = [(1, i, ["user", "assistant", "ro\nle<|", None][i % 4], [t(x)], 0) for i, x in enumerate(texts)]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()[0]
    assert [(x.role, x.text) for x in got.turns] == [(["user", "assistant", "ro\nle<|", ""][i % 4], x) for i, x in enumerate(texts)]
    assert got.loss == "".join(x for i, x in enumerate(texts) if i % 4 == 1)


def test_parts_become_ordered_placeholders(spark):
    parts = [t("see <"), t("|im_end|>"), ("image", None, "a.png", 576), t(None), None, ("audio", None, "b.wav", None), ("document", "ignored", "c.pdf", 10)]
    got = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts, 0)], SCHEMA)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()[0]
    assert [(a.message, a.part, a.type, a.ref, a.n_tokens) for a in got.attachments] == [(0, 0, "image", "a.png", 576), (0, 1, "audio", "b.wav", 0), (0, 2, "document", "c.pdf", 10)]
    assert got.attachment_tokens == 586
    assert got.formatted.count("<|im_end|>") == 1
    assert [p for p in ("<|image:0|>", "<|audio:1|>", "<|document:2|>") if p in got.formatted] == ["<|image:0|>", "<|audio:1|>", "<|document:2|>"]
    assert got.turns[0].text.startswith("see <|im_end|>")


@pytest.mark.parametrize("rows, n", [([], 0), ([(None, None, None, None, 1), (None, None, None, None, 1)], 1)])
def test_empty_and_null(spark, rows, n):
    got = chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == n
    if n:
        assert got[0].n_turns == 2 and got[0].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[0].loss_chars == 0


def test_long_text_and_repeated_turns(spark):
    rows = [(5, 1, "assistant", [t("x" * 300_000)], 0), (5, 1, "assistant", [t("b")], 0), (5, 0, "user", [t("q")], 0)]
    got = chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    assert got.loss_sha256 == hashlib.sha256(("b" + "x" * 300_000).encode()).hexdigest() and got.n_turns == 3


def test_query_against_brute_force(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], f"<|im_end|>\n {c} {t} ␛" if t % 3 else None, "clash", 1) for c in range(6) for t in range(9)]
    rows += [(1, None, "user", "null turn", "clash", 1), (None, 0, "user", "a", "x", 2), (None, 1, "assistant", "b", "x", 2), (2, 3, "user", "same", "x", 1), (2, 3, "user", "same", "x", 1), (9, 0, "assistant", "long " * 50_000, "x", 1)]
    rows += [(77, t, ["user", "assistant"][t % 2], f"turn {t} of the hot one", "x", 1) for t in range(20_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, start int").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_queries.op8_chat_format(spark, str(tmp_path)).collect()}
    extra = [(-7, 0, "user", chat_queries.EXTRA_TEXT), (-7, 1, "assistant", chat_queries.EXTRA_TEXT)]
    convs = {}
    for c, t, role, text, *_ in [*rows, *extra]:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, ms in convs.items():
        ms.sort()
        turns, loss = "".join(f"{m[2]}\n{m[3]}\n" for m in ms), "".join(m[3] for m in ms if m[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(ms), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
