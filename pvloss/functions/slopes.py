"""Order statistics of all pairwise slopes of a series without making the pairs.

For a slope s, the pairs no steeper than s are those that z = y - s x orders the other way round, so
counting inversions of z counts them. Bisection on s brackets the slope of a given rank until few pairs are
left inside, and only those are listed: they are the inversions between the orders at both ends of the bracket.
Memory is linear in the points; time is that of a few dozen sorts.
"""

from __future__ import annotations

import numpy as np

FEW = 256  # points whose pairs are simply made
LISTED = 8  # pairs for each point that are listed at most
STEPS = 200  # of a bisection


def inversions(v: np.ndarray, listed: int = 0) -> tuple[int, np.ndarray, np.ndarray]:
    """How many pairs of places a < b have v[a] >= v[b], and up to about `listed` such pairs (all, if there are no more).
    Blocks of twice the size are merged at each level; what a right half's value passes in the left half is counted."""
    n, total, left_of, right_of = len(v), 0, [], []
    rank = np.unique(v, return_inverse=True)[1].astype(np.int64)
    place, width = np.arange(n), 1
    while width < n:
        block, is_right = place // (2 * width), place // width % 2 == 1
        order = np.lexsort((~is_right, rank, block))  # right values come before equal left ones
        right, of = is_right[order], block[order]
        before = np.cumsum(~right)  # left values up to here, over all blocks
        ends = np.cumsum(np.bincount(of, ~right))  # and up to the end of each block
        count = np.where(right, ends[of] - before, 0).astype(np.int64)
        total += int(count.sum())
        if listed > 0 and count.any():
            some = np.flatnonzero(count)
            some = some[: np.searchsorted(np.cumsum(count[some]), listed) + 1]
            lefts, sizes = order[~right], count[some]
            at = np.repeat(before[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            left_of.append(lefts[at])
            right_of.append(np.repeat(order[some], sizes))
            listed -= int(sizes.sum())
        width *= 2
    none = np.empty(0, np.int64)
    return total, np.concatenate([none, *left_of]), np.concatenate([none, *right_of])


def ranked_slopes(x: np.ndarray, y: np.ndarray, ranks: list[int], few: int = FEW) -> list[float]:
    """The slopes of the given ranks (0 is the smallest) among all pairs of points; x rises."""
    n = len(x)
    if n <= few:
        i, j = np.triu_indices(n, 1)
        slopes = np.sort((y[j] - y[i]) / (x[j] - x[i]))
        return [float(slopes[k]) for k in ranks]
    steps = np.diff(y) / np.diff(x)  # every slope is a mean of these
    margin = 1e-9 * max(1.0, float(np.abs(steps).max()))
    count = lambda s: inversions(y - s * x)[0]  # noqa: E731  pairs no steeper than s
    known: dict[int, float] = {}
    for k in sorted(set(ranks)):
        low, high, below, upto = float(steps.min()) - margin, float(steps.max()) + margin, 0, n * (n - 1) // 2
        for _ in range(STEPS):
            middle = (low + high) / 2
            if upto - below <= LISTED * n or not low < middle < high:
                break
            c = count(middle)
            low, high, below, upto = (low, middle, below, c) if c > k else (middle, high, c, upto)
        order = np.lexsort((-x, y - low * x))  # of equal values the later point first, as its slope to the earlier is no steeper
        few_pairs = upto - below <= LISTED * n
        _, a, b = inversions((y - high * x)[order], LISTED * n if few_pairs else 1)
        i, j = order[a], order[b]
        inside = np.sort((y[j] - y[i]) / (x[j] - x[i]))
        known[k] = float(inside[min(k - below, len(inside) - 1)])  # a bracket without width holds one slope only
    return [known[k] for k in ranks]
