"""Token counts that follow edits without counting the whole document again.

build() keeps a segment tree for each document over its pre-tokens: leaves hold runs of pre-tokens (their
lengths in characters and their token counts), nodes hold sums of characters and tokens; the root has the
count. Its rows (doc_id, text, n_tokens, tree) are meant to be written as a table; edits come later and
are applied by apply_edits(), which reads the kept trees. An edit replaces characters [start, end) of the
text. Only the leaves that edits touch are opened, plus boundary context: re-splitting starts at the first
pre-token that could have looked at an edited character and goes on until a new boundary falls on an old
one behind the edit; from there on the old pre-tokens hold, as the pattern never looks back. New
pre-tokens are encoded, leaf sums and the sums on their paths to the root are updated, and leaves that
have grown are split.

Edits of a document are an array of (start, end, replacement) in characters of the kept text. They are
put in order of start, then end, then replacement; an edit that starts before the end of the one before
it, lies outside the text or has start > end is skipped and counted in n_skipped.

Defined cases: a null text counts as empty; null edits and null arrays are no edits; a null replacement
deletes; an empty document has a tree without leaves; repeated rows and null ids stay, each with a tree
of its own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, slices
from .units import UnitStore

LEAF = 64  # pre-tokens of a leaf when a tree is built; leaves of more than twice as many are split
LOOK = 3  # characters behind its end that a pre-token's match may have looked at
EDIT = "struct<start:bigint,end:bigint,replacement:string>"
PARTS = ("leaves", "lengths", "counts", "chars", "tokens")  # pre-tokens of each leaf, of all: characters and tokens; node sums
TREE = f"struct<{','.join(f'{p}:binary' for p in PARTS)}>"


def narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, after one byte that tells how many."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widened(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def node_sums(of_leaves: np.ndarray) -> np.ndarray:
    """Sums of all nodes: node 1 is the root, the children of k are 2 k and 2 k + 1, leaves come last."""
    size = 1
    while size < len(of_leaves):
        size *= 2
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(of_leaves)] = of_leaves
    while size > 1:
        out[size // 2 : size] = out[size : 2 * size].reshape(-1, 2).sum(axis=1)
        size //= 2
    return out


class Tree:
    """A document's tree. Leaves are cut from the arrays of all pre-tokens when they are opened; those
    that were put again are held apart."""

    def __init__(self, leaves: np.ndarray, lengths: np.ndarray, counts: np.ndarray, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.sizes, self.lengths, self.counts = leaves, lengths, counts
        self.ends = np.cumsum(leaves)
        self.chars = node_sums(self._of_leaves(lengths)) if chars is None else chars
        self.tokens = node_sums(self._of_leaves(counts)) if tokens is None else tokens
        self.size, self.opened = len(self.chars) // 2, {}

    def _of_leaves(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.ends], prepend=0)

    @classmethod
    def over(cls, lengths: np.ndarray, counts: np.ndarray) -> Tree:
        n = len(lengths)
        return cls(np.diff(np.minimum(np.arange(0, n + LEAF, LEAF), n)) if n else np.zeros(0, np.int64), lengths, counts)

    @classmethod
    def read(cls, parts: dict[str, bytes]) -> Tree:
        return cls(*[widened(parts[p]) for p in PARTS])

    def parts(self) -> dict[str, bytes]:
        return dict(zip(PARTS, map(narrow, (self.sizes, self.lengths, self.counts, self.chars, self.tokens)), strict=True))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def n_leaves(self) -> int:
        return len(self.sizes)

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        k, at = 1, 0
        while k < self.size:
            k *= 2
            if char >= at + self.chars[k] and self.chars[k + 1]:
                at += int(self.chars[k])
                k += 1
        return k - self.size, at

    def leaf(self, i: int) -> tuple[list[int], list[int]]:
        if i not in self.opened:
            a, b = int(self.ends[i] - self.sizes[i]), int(self.ends[i])
            return self.lengths[a:b].tolist(), self.counts[a:b].tolist()
        return self.opened[i]

    def put(self, i: int, lengths: list[int], counts: list[int]) -> None:
        self.opened[i] = (lengths, counts)
        k = self.size + i
        more_chars, more_tokens = sum(lengths) - int(self.chars[k]), sum(counts) - int(self.tokens[k])
        while k:
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2

    def settled(self) -> Tree:
        """The tree with its opened leaves written back; those that have grown are split, empty ones go."""
        if not self.opened:
            return self
        runs = []
        for i in range(self.n_leaves):
            lengths, counts = self.leaf(i)
            pieces = -(-len(lengths) // LEAF) if len(lengths) > 2 * LEAF else 1
            cut = [len(lengths) * k // pieces for k in range(pieces + 1)]
            runs += [(lengths[a:b], counts[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]
        flat = [np.fromiter(chain.from_iterable(r[k] for r in runs), np.int64) for k in (0, 1)]
        return Tree(np.array([len(r[0]) for r in runs], np.int64), *flat)


class Cursor:
    """A place between old pre-tokens that moves forward: leaf, place in the leaf, and its character."""

    def __init__(self, tree: Tree):
        self.tree, self.leaf, self.place, self.char = tree, 0, 0, 0
        self.of, self.lengths = -1, []  # the leaf that is open, and its pre-tokens

    def length(self) -> int | None:
        """Characters of the next pre-token; None at the end."""
        while self.leaf < self.tree.n_leaves:
            if self.of != self.leaf:
                self.of, self.lengths = self.leaf, self.tree.leaf(self.leaf)[0]
            if self.place < len(self.lengths):
                return self.lengths[self.place]
            if self.leaf + 1 == self.tree.n_leaves:
                break
            self.leaf, self.place = self.leaf + 1, 0
        return None

    def forward(self) -> None:
        self.char += self.length()
        self.place += 1

    def to_look(self, start: int) -> None:
        """To the first pre-token, from here on, whose match may have looked at character `start`."""
        if self.tree.n_leaves:
            leaf, char = self.tree.find(max(0, start - LOOK))
            if char > self.char:
                self.leaf, self.place, self.char = leaf, 0, char
        while (n := self.length()) is not None and self.char + n + LOOK <= start:
            self.forward()


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with edits, which are in order and don't overlap, applied at once."""
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


class Counter:
    """Counts with one vocabulary; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.codec, self.match = codec(path, pattern), regex.compile(pattern).match
        self.units = UnitStore(self._units, np.uint64, 250_000)

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.codec.pre_tokens(pieces)]

    def _units(self, texts: list[str], inner: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit its pre-tokens: characters in the upper 32 bits, tokens in the lower."""
        split = self.codec.split(texts, inner)
        flat = list(chain.from_iterable(split))
        lengths, counts = np.fromiter(map(len, flat), np.uint64, len(flat)), np.array(self.counts(flat), np.uint64)
        return lengths << np.uint64(32) | counts, np.fromiter(map(len, split), np.int64, len(split))

    def trees(self, texts: pa.Array) -> list[Tree]:
        both, ends = self.units.many(texts)
        lengths, counts = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return [Tree.over(lengths[a:b], counts[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(texts) else []

    def edit(self, tree: Tree, text: str, edits: list[tuple[int, int, str]]) -> tuple[Tree, str, int]:
        """Applies edits (in order, apart) to the tree of `text`; -> the new tree, the new text, how many
        characters were re-encoded."""
        after, cursor, shift, k, redone, changes = edited(text, edits), Cursor(tree), 0, 0, 0, []
        while k < len(edits):
            cursor.to_look(edits[k][0])
            begin = (cursor.leaf, cursor.place)
            pos, fresh, old_end, new_end = cursor.char + shift, [], -1, -1
            while True:
                # Edits whose place the new pre-tokens have reached belong to this change.
                while k < len(edits) and (old_end < 0 or edits[k][0] + shift <= pos):
                    start, end, new = edits[k]
                    old_end, new_end = end, start + shift + len(new)
                    shift += len(new) - (end - start)
                    k += 1
                if pos >= new_end and (here := pos - shift) >= old_end:
                    while cursor.char < here and cursor.length() is not None:
                        cursor.forward()
                    if cursor.char == here:
                        break
                m = self.match(after, pos)
                fresh.append(m.group())
                pos = m.end()
            redone += sum(map(len, fresh))
            changes.append((begin, (cursor.leaf, cursor.place), fresh))
        numbers = self.counts([p for _, _, fresh in changes for p in fresh])
        for (leaf, place), (last, rest), fresh in reversed(changes):  # from the right, so that places hold
            counts = numbers[len(numbers) - len(fresh) :]
            del numbers[len(numbers) - len(fresh) :]
            if not tree.n_leaves:
                return Tree.over(np.array([len(p) for p in fresh], np.int64), np.array(counts, np.int64)), after, redone
            head, tail = tree.leaf(leaf), tree.leaf(last)
            for i in range(leaf + 1, last + 1):
                tree.put(i, [], [])
            tree.put(leaf, [*head[0][:place], *map(len, fresh), *tail[0][rest:]], [*head[1][:place], *counts, *tail[1][rest:]])
        return tree, after, redone


@cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def build(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, n_tokens, tree: the table of kept trees."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = counter(path, pattern)
        for big in batches:
            for batch in slices(big, "text"):
                trees = own.trees(batch.column("text"))
                kept = pa.array([t.parts() for t in trees], pa.struct([(p, pa.binary()) for p in PARTS]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.total for t in trees], pa.int64()), kept], names=["doc_id", "text", "n_tokens", "tree"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_tokens bigint, tree {TREE}")


def redactions(trees: DataFrame, pattern: str, replacement: str, hint: str | None = None) -> DataFrame:
    """build()'s rows with `edits` that put `replacement` for each match of a pattern. Texts without a
    match of `hint`, which every match must hold, are not searched; it is looked for in the JVM."""
    rows = trees.select("doc_id", "text", "n_tokens", "tree")
    asked = rows.withColumn("asked", F.col("text") if hint is None else F.when(F.col("text").rlike(hint), F.col("text")))
    rows = asked.select("doc_id", F.col("asked").alias("text"), "n_tokens", F.when(F.col("asked").isNotNull(), F.col("tree")).alias("tree"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        find = re.compile(pattern).finditer
        for big in batches:
            for batch in slices(big, "text"):
                found = [[(*m.span(), replacement) for m in find(t)] if t else None for t in batch.column("text").to_pylist()]
                edits = pa.array([[{"start": a, "end": b, "replacement": c} for a, b, c in f] if f else None for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())])))
                yield pa.RecordBatch.from_arrays([*batch.columns, edits], names=["doc_id", "text", "n_tokens", "tree", "edits"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_tokens bigint, tree {TREE}, edits array<{EDIT}>")


def apply_edits(trees: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """build()'s rows with `edits` (array of EDIT) -> doc_id, n_before, n_edits, n_skipped, n_after,
    reencoded_chars, and with keep the edited text and its tree. Rows without edits need neither text nor tree
    unless keep asks for them."""
    has = F.size(F.coalesce("edits", F.array().cast(f"array<{EDIT}>"))) > 0
    rows = trees.select("doc_id", "n_tokens", F.col("edits").cast(f"array<{EDIT}>").alias("edits"), *[F.col(c) if keep else F.when(has, F.col(c)).alias(c) for c in ("text", "tree")])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = counter(path, pattern)
        for big in batches:
            for batch in slices(big, "text"):
                out = []
                for total, asked, text, kept in zip(*[batch.column(c).to_pylist() for c in ("n_tokens", "edits", "text", "tree")], strict=True):
                    todo = sorted((e["start"], e["end"], e["replacement"] or "") for e in asked or [] if e and None not in (e["start"], e["end"]))
                    good, free = [], 0
                    for e in todo:
                        if free <= e[0] <= e[1] <= len(text):
                            good.append(e)
                            free = e[1]
                    if not good:
                        out.append((total, 0, len(todo), total, 0, text, kept))
                        continue
                    tree, text, redone = own.edit(Tree.read(kept), text, good)
                    out.append((total, len(good), len(todo) - len(good), tree.total, redone, text, tree.settled().parts() if keep else None))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.struct([(p, pa.binary()) for p in PARTS])]
                columns = [batch.column("doc_id"), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]]
                n = len(NAMES) if keep else len(NAMES) - 2
                yield pa.RecordBatch.from_arrays(columns[:n], names=NAMES[:n])

    schema = f"doc_id {kind}, n_before bigint, n_edits bigint, n_skipped bigint, n_after bigint, reencoded_chars bigint"
    return rows.mapInArrow(run, schema + (f", text string, tree {TREE}" if keep else ""))


NAMES = ["doc_id", "n_before", "n_edits", "n_skipped", "n_after", "reencoded_chars", "text", "tree"]
