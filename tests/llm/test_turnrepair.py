import hashlib
import random
import re
import zlib

import pytest

from pvloss.llm import turnrepair, turnrepair_queries
from pvloss.llm.turnrepair import CUT, GONE, INITIAL, A, S, U

MOVES = {("", S): "s", ("", U): "u", ("s", U): "u", ("u", A): "e", ("e", U): "u"}


def closed(best):
    """Inserts until nothing gets cheaper."""
    while True:
        new = dict(best)
        for q, (cost, audit) in best.items():
            for c in (U, A):
                if to := MOVES.get((q, c)):
                    new[to] = min(new.get(to, (10**9, "")), (cost + 3, audit + "I"))
        if new == best:
            return best
        best = new


def slow_align(codes):
    """Least (cost, audit) over the states of the grammar, turn by turn."""
    best = closed({"": (0, "")})
    for c in codes:
        new = {}

        def put(q, cost, audit):
            if q is not None:
                new[q] = min(new.get(q, (10**9, "")), (cost, audit))

        for q, (cost, audit) in best.items():
            put(q, cost + 4, audit + "D")
            if not c & GONE:
                more = 3 if c & CUT else 0
                put(MOVES.get((q, c & INITIAL)), cost + more, audit + "K")
                for to in (U, A):
                    put(MOVES.get((q, to)), cost + 3 + more, audit + "R")
        best = closed(new)
    return min(best[q] for q in ("", "e") if q in best)


def test_align_equals_the_grammar_automaton():
    rng = random.Random(5)
    for k in range(3000):
        n = rng.choice([0, 1, 2, 3, 5, 8, 13])
        some = [S, U, A, 0] if k % 2 else [U, A]
        codes = bytes(rng.choice(some) | rng.choice([0, 0, 0, GONE, CUT]) for _ in range(n))
        assert turnrepair.align(codes) == slow_align(codes), list(codes)


@pytest.mark.parametrize("n", [64, 65, 200, 700])
def test_long_conversations(n):
    rng = random.Random(n)
    codes = bytearray((S if i == 0 and n % 2 else U if i % 2 == n % 2 else A) for i in range(n))
    for i in range(n):
        if rng.random() < 0.2:
            codes[i] = rng.choice([U, A, A | GONE, U | CUT, A | CUT, S, 0])
    assert turnrepair.align(bytes(codes)) == slow_align(codes)
    worst = bytes([0]) * 70 + bytes([S]) * 70 + bytes([U | CUT]) * 70
    assert turnrepair.align(worst) == slow_align(worst)


def slow_query(rows):
    """The contract, conversation by conversation."""
    out, convs = [], {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        codes, seen, faults = [], set(), [0, 0, 0]
        for turn, role, text in turns:
            code = "-sua".index(role[0]) if role and role[0] in "sua" else 0
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            codes.append(code | (GONE if kind in (0, 1) else CUT if kind == 2 else 0))
        days = [t for t, *_ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = slow_align(codes)
        size, at, lines = len(audit.replace("D", "")), 0, []
        target = ["system"] * (size % 2) + ["user", "assistant"] * (size // 2)
        for letter in audit:
            if letter != "I":
                _, role, text = turns[at]
                at += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else target[len(lines)]}:{'' if letter == 'I' else text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(days) - min(days) + 1 - len(set(days)) if days else 0, *faults, illegal, cost, audit, sha))
    return sorted(out, key=str)


def fixture():
    rng, rows = random.Random(11), []
    for conv in [*range(150), None]:
        for turn in range(rng.choice([1, 2, 3, 6, 9, 40])):
            role = rng.choice(["system", "tool", "", None, "User"]) if rng.random() < 0.1 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "What?\n", "cut off", " \t\n", None, "É ü.\x0b", f"text {conv} {turn}.", f"end {turn} {rng.random()}?"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 3]), role, text, "x"))
    long = [(1000, i, "user" if i % 2 == 0 else "assistant", f"turn {i}." if i % 7 else "same.", None) for i in range(600)]
    return [*rows, *long, *rows[:5], (2000, 3, "user", "w " * 300_000 + ".", "y")]


def test_query_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turnrepair_queries.op12_turn_repair(spark, str(tmp_path))
    assert got.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in turnrepair.COUNTS], ("audit", "string"), ("repaired_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == slow_query(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Hi."), (1, 1, "assistant", "One."), (1, 2, "assistant", "One."), (1, 3, "tool", "x."), (1, 4, "user", "Two?"), (2, 0, "user", ""), (3, None, "user", "a.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = turnrepair.audits(turns, spark.createDataFrame([(9,), (1,)], "conv_id long"))
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {i: slow_align(c) for i, c in {1: bytes([S, A, A | GONE, 0, U]), 2: bytes([U | GONE]), 3: bytes([U]), 9: b""}.items()}
    got = [(r.conv_id, r.at, r.role, r.text, r.edit) for r in turnrepair.repaired(turns, found).collect()]
    assert sorted(got) == [(1, 1, "system", "Hi.", "K"), (1, 2, "user", "", "I"), (1, 3, "assistant", "One.", "K"), (1, 4, "user", "x.", "R"), (1, 5, "assistant", "Two?", "R"), (3, 1, "user", "a.", "K"), (3, 2, "assistant", "", "I")]
    none = turns.limit(0)
    assert turnrepair.with_digest(none, turnrepair.audits(none)).collect() == []
