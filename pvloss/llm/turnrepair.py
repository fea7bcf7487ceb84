"""Conversation structure repair: faults of the turns, and the cheapest edits that give them the order of the
grammar (s?(ua)+)? over the initials of their roles.

The turns of a conversation are aligned with every target that the grammar allows: alternating strings of each
even length, or a kept s before one. Written from their end, shorter alternating strings are parts of longer ones, so
one Wagner-Fischer table over (turns left, target characters left) holds the alignments with all lengths. It
is filled within Ukkonen bands: a greedy repair gives an incumbent cost, every turn has a cost that no repair avoids,
and cells that would cost more than the incumbent are left out. Of the lengths of least cost, the audits
are traced back together, letter by letter, and only those with the smallest letter go on.
The table keeps every B-th row and fills the rows between again when the trace comes by.

Rows are sorted by conversation and streamed. The first pass holds one byte and one digest for each turn of one
conversation; the second hands the audit to the sorted texts and edits them one by one, so the texts of
a conversation are never gathered.

Costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty text 3; a truncated turn that isn't deleted
adds 3. Blank and duplicate turns must be deleted.

Defined cases: null roles and texts are one space; a null conv_id is a conversation; turns are ordered by turn (nulls
first), those of one turn by role and then by a digest; an empty role has no initial, fits nothing and is no legal neighbour; further
columns are ignored; a conversation without turns has no faults, cost 0 and an empty audit; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
S, U, A, INITIAL, GONE, CUT = 1, 2, 3, 3, 4, 8  # bits of a turn's code: initial, must be deleted, truncated
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {(S, U), (U, A), (A, U)}
FAR = 1 << 40


def greedy(codes: bytes) -> int:
    """What a repair from left to right costs beyond the cost that no repair avoids: it keeps every u and a, and
    inserts what is missing before them."""
    extra, want, with_s, pairs = 0, U, False, False
    for c in codes:
        initial = c & INITIAL
        if c & GONE:
            continue
        if initial == S and not (with_s or pairs or want == A):
            with_s = True
            continue
        if initial != want:
            extra += INSERT if initial in (U, A) else REROLE
        if initial not in (U, A) or initial == want:
            want = A if want == U else U
        pairs = True
    if want == A:
        return extra + INSERT
    return extra + 2 * INSERT if with_s and not pairs else extra


class Table:
    """F[i][r]: the least cost to make the last r characters of ...uaua of the turns from i on."""

    def __init__(self, codes: bytes):
        self.codes, n = codes, len(codes)
        code = np.frombuffer(codes, np.uint8).astype(np.int64)
        gone, cut = code & GONE > 0, (code & CUT > 0) & (code & GONE == 0)
        left = lambda x: np.concatenate([np.cumsum(x[::-1], dtype=np.int64)[::-1], [0]])  # noqa: E731  sums from i on
        self.least = DELETE * int(gone.sum()) + TRUNCATED * int(cut.sum())
        spare = min(greedy(codes), DELETE * n - self.least)
        live, cuts = left(~gone), left(cut)
        # Beyond the least cost, a target longer than the live turns costs 3 a character, a shorter one 4 a turn or 1 if it is truncated.
        fewer = np.where(spare <= cuts, spare, cuts + (spare - cuts) // DELETE)
        self.low, self.high = np.maximum(0, live - fewer), live + spare // INSERT
        self.step = max(64, isqrt(n))
        row = INSERT * np.arange(self.low[n], self.high[n] + 1, dtype=np.int64)
        self.marks, self.held, self.first = {n: row}, {n: row}, []
        for i in range(n - 1, -1, -1):
            if codes[i] & INITIAL == S and not codes[i] & GONE:  # a kept s here, with all turns before it deleted
                self.first.append((DELETE * i + TRUNCATED * bool(codes[i] & CUT) + min([FAR, *self.even(i + 1, row)[1]]), i))
            row = self.fill(i, row)
            if i % self.step == 0:
                self.marks[i] = row
        self.top = row

    def fill(self, i: int, below: np.ndarray) -> np.ndarray:
        low, high, was = int(self.low[i]), int(self.high[i]), int(self.low[i + 1])
        padded = np.full(high - low + 2, FAR, np.int64)  # F[i + 1] at low - 1 .. high
        a, b = max(low - 1, was), min(high, was + len(below) - 1)
        if a <= b:
            padded[a - low + 1 : b - low + 2] = below[a - was : b - was + 1]
        r = np.arange(low, high + 1)
        row, c = DELETE + padded[1:], self.codes[i]
        if not c & GONE:
            kept = padded[:-1] + np.where(np.where(r % 2, A, U) == c & INITIAL, 0, REROLE) + TRUNCATED * bool(c & CUT)
            row = np.minimum(row, kept)
        return np.minimum.accumulate(row - INSERT * r) + INSERT * r

    def even(self, i: int, row: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        low = int(self.low[i])
        start = max(least, low + low % 2)
        return np.arange(start, low + len(row), 2), row[start - low :: 2]

    def at(self, i: int, r: np.ndarray) -> np.ndarray:
        """F[i][r] for several r."""
        if i not in self.held:
            top = min(len(self.codes), (i // self.step + 1) * self.step)
            row, self.held = self.marks[top], {top: self.marks[top]}
            for k in range(top - 1, i // self.step * self.step - 1, -1):
                self.held[k] = row = self.fill(k, row)
        row, place = self.held[i], r - int(self.low[i])
        inside = (place >= 0) & (place < len(row))
        return np.where(inside, row[np.where(inside, place, 0)], FAR)

    def trace(self, i: int, r: np.ndarray) -> str:
        """The ASCII-least audit of the turns from i on, over targets of r characters, all of one cost."""
        out, n = [], len(self.codes)
        while i < n:
            cost = self.at(i, r)
            if (go := DELETE + self.at(i + 1, r) == cost).any():
                letter, r, i = "D", r[go], i + 1
            elif (go := (r > 0) & (INSERT + self.at(i, r - 1) == cost)).any():
                letter, r = "I", r[go] - 1
            else:
                c = self.codes[i]
                go = TRUNCATED * bool(c & CUT) + self.at(i + 1, r - 1)
                keep = (np.where(r % 2, A, U) == c & INITIAL) & (go == cost)
                letter, r, i = ("K", r[keep] - 1, i + 1) if keep.any() else ("R", r[go + REROLE == cost] - 1, i + 1)
            out.append(letter)
        return "".join(out) + "I" * int(r.min())


def align(codes: bytes) -> tuple[int, str]:
    """The least cost of a repair and the ASCII-least of its audits."""
    if not codes:
        return 0, ""
    table = Table(codes)
    lengths, costs = table.even(0, table.top, 0)
    best = min([FAR, *costs])
    with_s, at = min(table.first, key=lambda x: (x[0], -x[1]), default=(FAR, 0))  # of equal costs the longer run of D
    audits = [table.trace(0, lengths[costs == best])] if best <= with_s else []
    if with_s <= best:
        first = int(at) + 1
        rest = table.even(first, table.at(first, np.arange(table.low[first], table.high[first] + 1)))
        audits.append("D" * at + "K" + table.trace(first, rest[0][rest[1] == rest[1].min()]))
    return int(min(best, with_s)), min(audits)


@lru_cache(1 << 14)
def _short(codes: bytes) -> tuple[int, str]:
    return align(codes)


def ordered(turns: DataFrame) -> DataFrame:
    """turns with a digest of role and text, nulls as one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(turns: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each
    conversation of turns, and of `named` (conv_id), whose conversations may have no turns."""
    rows = ordered(turns)
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int")
    code = initial + F.when(bare == "", GONE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), code.alias("code"), F.unhex("digest").alias("digest"), "role")
    if named is not None:
        rows = rows.unionByName(named.select("conv_id", F.lit(None).cast("int").alias("code")).distinct(), allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest").drop("role")
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])

    def run(batches):
        done, conv, codes, seen, days, faults = [], None, None, set(), [None, None, 0], [0, 0, 0]

        def close():
            initials = [c & INITIAL for c in codes]
            illegal = sum(x not in LEGAL for x in zip(initials, initials[1:]))
            cost, audit = (_short if len(codes) <= 64 else align)(bytes(codes))
            gaps = 0 if days[0] is None else days[1] - days[0] + 1 - days[2]
            done.append((conv, gaps, *faults, illegal, cost, audit))

        def out():
            columns = zip(*done) if done else [[] for _ in schema.names]
            batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(map(list, columns), kinds, strict=True)], names=schema.names)
            done.clear()
            return batch

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string()]
            for cid, turn, code, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "digest")), strict=True):
                if codes is None or cid != conv:
                    if codes is not None:
                        close()
                    conv, codes, seen, days, faults = cid, bytearray(), set(), [None, None, 0], [0, 0, 0]
                if code is None:
                    continue
                if turn is not None and turn != days[1]:
                    days = [turn if days[0] is None else days[0], turn, days[2] + 1]
                if code & GONE:
                    faults[0] += 1
                elif digest in seen:
                    faults[1] += 1
                    code = code & INITIAL | GONE
                elif code & CUT:
                    faults[2] += 1
                seen.add(digest)
                codes.append(code)
            if done:
                yield out()
        if codes is not None:
            close()
            yield out()

    return rows.mapInArrow(run, schema)


ROLE = {U: "user", A: "assistant"}


def _edits(batches):
    """Sorted rows (conv_id, audit on the first row of each conversation, role, text) -> for each conversation its first row's
    place and batch, then (role, text, letter) for each turn of the repaired conversation, deleted ones left out."""
    audit, at, want = None, 0, None
    step = lambda: A if want == U else U

    for batch in batches:
        for i, (letters, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("audit", "role", "text")), strict=True)):
            if letters is not None:
                if audit is not None:
                    yield from _inserted(audit, at, want)
                yield batch, i
                size = len(letters) - letters.count("D")
                audit, at, want = letters, 0, S if size % 2 else U
                continue
            while audit[at] == "I":
                yield ROLE[want], "", "I"
                at, want = at + 1, step()
            letter, at = audit[at], at + 1
            if letter != "D":
                yield (role if letter == "K" else ROLE[want]), text, letter
                want = step()
    if audit is not None:
        yield from _inserted(audit, at, want)


def _inserted(audit: str, at: int, want: int):
    for k in range(len(audit) - at):
        yield ROLE[want if k % 2 == 0 else U + A - want], "", "I"


def _together(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation before its sorted turns, all of one conversation in one partition."""
    heads = found.select("*", F.lit(0).alias("_head"))
    rows = ordered(turns).withColumn("_head", F.lit(1)).withColumn("turn", F.col("turn").cast("bigint"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_head", F.asc_nulls_first("turn"), "role", "digest")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """turns and their audits -> conv_id, at (1, 2, ...), role, text, edit: the repaired conversations."""
    rows = _together(turns, found).select("conv_id", "audit", "role", "text")
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, k) for c, k in (("at", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("edit", T.StringType()))]])

    def run(batches):
        held, size, conv, at, kind = [], 0, None, 0, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held), [kind, pa.int64(), *[pa.string()] * 3], strict=True)], names=schema.names)
        for item in _edits(batches):
            if len(item) == 2:
                conv, at, kind = item[0].column("conv_id")[item[1]].as_py(), 0, item[0].schema.field("conv_id").type
                continue
            at += 1
            held.append((conv, at, *item))
            size += len(item[1])
            if size > 1 << 21 or len(held) >= 10_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, schema)


def with_digest(turns: DataFrame, found: DataFrame, name: str = "repaired_sha256") -> DataFrame:
    """found with the SHA-256 of each repaired conversation, written as role:text lines joined by newlines."""
    rows = _together(turns, found).select(*found.columns, "role", "text")
    schema = T.StructType([*found.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        sha, first, heads, digests = None, True, [], []
        for item in _edits(batches):
            if len(item) == 2:
                if sha is not None:
                    digests.append(sha.hexdigest())
                if len(digests) >= 1000:
                    yield pa.RecordBatch.from_arrays([*pa.concat_batches(heads).columns, pa.array(digests)], names=schema.names)
                    heads, digests = [], []
                heads.append(pa.RecordBatch.from_arrays([item[0].column(c).slice(item[1], 1) for c in found_names], names=found_names))
                sha, first = hashlib.sha256(), True
                continue
            sha.update(("" if first else "\n").encode() + f"{item[0]}:{item[1]}".encode())
            first = False
        if sha is not None:
            yield pa.RecordBatch.from_arrays([*pa.concat_batches(heads).columns, pa.array([*digests, sha.hexdigest()])], names=schema.names)

    found_names = found.columns
    return rows.mapInArrow(run, schema)
