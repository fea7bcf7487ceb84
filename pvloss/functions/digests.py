"""MD5 of many short texts that begin alike, in numpy: the same digests as F.md5 and DuckDB's md5, for draws that SQL makes too.
hashlib takes a call for each text; here all texts of a chunk go through the 64 steps (RFC 1321) together."""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np

ONE_BLOCK = 55  # bytes of a text that is digested in one go, as its end and length fill the 64
TOGETHER = 16384  # texts that go through the steps together
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADDED = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
TURNED = [k for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for k in turn * 4]
WORD = [(m * i + k) % 16 for m, k in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]


def _words(prefix: bytes, ends: np.ndarray) -> list:
    """The 16 words of each text's block: a number where it is the same for all texts, else an array."""
    n, width, p = len(ends), ends.dtype.itemsize, len(prefix)
    first = p // 4 * 4  # the words before are the prefix's alone
    varied = np.zeros((n, -(-(p + width + 1 - first) // 4) * 4), np.uint8)
    varied[:, : p - first] = np.frombuffer(prefix[first:], np.uint8)
    tail = np.ascontiguousarray(ends).view(np.uint8).reshape(n, width)
    varied[:, p - first : p - first + width] = tail
    length = p + np.count_nonzero(tail, axis=1)
    varied[np.arange(n), length - first] = 0x80
    words = [int(w) for w in np.frombuffer(prefix[:first], "<u4")] + list(np.ascontiguousarray(varied.view("<u4").T))
    return words + [0] * (14 - len(words)) + [(8 * length).astype(np.uint32), 0]


def _digests(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two of the four words of each digest."""
    u = np.uint32
    a, b, c, d = (np.full(n, v, u) for v in START)
    f = np.empty(n, u)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word, known = words[WORD[i]], ADDED[i]
        a += f
        if isinstance(word, int):
            known = (known + word) & 0xFFFFFFFF
        else:
            a += word
        a += u(known)
        np.right_shift(a, u(32 - TURNED[i]), out=f)
        a <<= u(TURNED[i])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return a + u(START[0]), b + u(START[1])


def fractions(prefix: bytes, ends: np.ndarray) -> np.ndarray:
    """For each of ends (numpy bytes without zeros) a number in [0, 1): the first 48 bits of the digest of prefix + end."""
    if len(prefix) + ends.dtype.itemsize > ONE_BLOCK:
        first, out = md5(prefix), bytearray()
        for end in ends.tolist():
            h = first.copy()
            h.update(end)
            out += h.digest()[:6]
        return np.frombuffer(bytes(out), np.uint8).reshape(-1, 6) @ 256.0 ** np.arange(5, -1, -1) / 256.0**6
    out = np.empty(len(ends))
    for at in range(0, len(ends), TOGETHER):
        part = ends[at : at + TOGETHER]
        a, b = _digests(_words(prefix, part), len(part))
        out[at : at + len(part)] = (a.byteswap() * 65536.0 + (b.byteswap() >> 16)) / 2.0**48
    return out
