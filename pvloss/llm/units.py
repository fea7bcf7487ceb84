"""Splitting texts for byte-level BPE, and a bounded store of encoded units.

A unit is a stretch of text between single spaces that stand between two non-space characters. The
pre-token pattern attaches such a space to what follows it and looks no further back, so the
pre-tokens of a text are those of its units, one after the other. Units repeat a lot, so each Python
worker encodes each unit once and keeps its values. Texts are split and looked up a batch at a time:
Arrow numbers the different units of a batch, and only these meet Python.

The store has two generations: when the young one is full it becomes the old one, and what is still
used is copied back. Units over MAX_UNIT characters are never kept. So its memory is bounded.

Defined cases: an empty text is one empty unit; texts must not be null; an empty batch gives no values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_UNIT = 64
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that is no boundary: at an end of the text or beside other white space.
_ODD = rf"(?s)\A | \z|{_WHITE} | {_WHITE}"


def units(text: str) -> list[str]:
    """The units of a text without the spaces that join them: text == ' '.join(units(text))."""
    return _BOUNDARY.split(text)


def strings(texts: pa.Array) -> list[str]:
    """The texts of an array without nulls; much faster than to_pylist()."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `values` one after the other in the order of `pick`; -> them, and where each ends."""
    n = sizes[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[pick] - (ends - n), n) + np.arange(total)], ends


class Generation:
    """Units by number, and their values in one array."""

    def __init__(self, kind):
        self.number: dict[str, int] = {}
        self.values, self.starts, self.sizes = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """-> the numbers of the units that are added."""
        first = len(self.sizes)
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.sizes, self.values = np.concatenate([self.sizes, sizes]), np.concatenate([self.values, values])
        return np.arange(first, len(self.sizes))


class UnitStore:
    """encode: (list of texts, inner) -> (values of all of them in one array, how many each has). If inner
    holds, the texts are units that lack the space before them; neither end of them is white."""

    def __init__(self, encode: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]], kind, most: int = 700_000):
        self.encode, self.kind, self.half = encode, kind, max(1, most // 2)
        self.young, self.old = Generation(kind), Generation(kind)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of units (given without their leading space) in the young generation."""
        young, old = self.young, self.old
        number = np.fromiter(map(young.number.get, words, repeat(-1)), np.int64, len(words))
        absent = np.flatnonzero(number < 0)
        if not len(absent):
            return number
        missing = [words[i] for i in absent.tolist()]
        there = np.fromiter(map(old.number.get, missing, repeat(-1)), np.int64, len(missing))
        known, new = absent[there >= 0], absent[there < 0]
        if len(known):
            there = there[there >= 0]
            number[known] = young.add(ragged(old.values, old.starts, old.sizes, there)[0], old.sizes[there])
        if len(new):
            number[new] = young.add(*self.encode([words[i] for i in new.tolist()], True))
        found = zip(missing, number[absent].tolist(), strict=True)
        young.number.update(found if max(map(len, missing)) <= MAX_UNIT else [(w, n) for w, n in found if len(w) <= MAX_UNIT])
        return number

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts (strings without nulls) -> the values of all texts in one array, where each text's end."""
        if not len(texts):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        slow = pa.array([units(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        count = np.empty(len(texts), np.int64)
        count[~odd], count[odd] = pc.list_value_length(plain).to_numpy(), pc.list_value_length(slow).to_numpy()
        all_units = pa.chunked_array([plain.flatten(), slow.flatten()]).combine_chunks()
        # Texts stand with the plain ones first, then the others, until the end.
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        ends = np.cumsum(count[order])
        head = np.zeros(len(all_units), bool)
        head[ends - count[order]] = True
        rest = all_units.filter(pa.array(~head)).dictionary_encode()
        own = self._numbers(strings(rest.dictionary))
        values, sizes = self.encode(strings(all_units.filter(pa.array(head))), False)
        young, base = self.young, len(self.young.sizes)
        number = np.empty(len(all_units), np.int64)
        number[head] = base + np.arange(len(sizes))
        number[~head] = own[rest.indices.to_numpy()]
        starts = np.concatenate([young.starts, len(young.values) + np.cumsum(sizes) - sizes])
        pick = number
        if odd.any():  # back to the order of the texts
            begin = np.empty(len(texts), np.int64)
            begin[order] = ends - count[order]
            pick = ragged(number, begin, count, np.arange(len(texts)))[0]
        out, unit_ends = ragged(np.concatenate([young.values, values]), starts, np.concatenate([young.sizes, sizes]), pick)
        if len(young.sizes) > self.half:
            self.old = young if len(young.sizes) <= 2 * self.half else Generation(self.kind)
            self.young = Generation(self.kind)
        return out, unit_ends[np.cumsum(count) - 1]
