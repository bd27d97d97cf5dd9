"""Signature trees over sets of 64-bit hashes.

A leaf holds a set's bitmap and size; a node above holds the OR of its
children's bitmaps and the range of their sizes.  For any x below node A and y
below node B, |x & y| is at most the bits that A and B share plus the tokens
that fall on another token's bit inside one set, so a pair of nodes is pruned
when that is below what the smallest sizes need, or when the size ranges rule
the similarity out.  Two trees are traversed together, level by level.
"""

from __future__ import annotations

import numpy as np

from .components import Forest

FAN = 8
MOST_BITS = 1 << 17
PAIRS = 2048  # of nodes that are opened at once
BLOCK = 1 << 19  # 64-bit words of bitmaps compared at once


def enough(common: int, a: int, b: int) -> bool:
    """100 * common >= 75 * union, in whole numbers."""
    return 7 * common >= 3 * (a + b)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def bitmap_of(tokens: np.ndarray) -> np.ndarray:
    """Bits of a set, 3 to 6 a token up to ``MOST_BITS``, as 64-bit words."""
    width = min(MOST_BITS, max(64, 1 << (3 * len(tokens) - 1).bit_length()))
    bit = (tokens >> np.uint64(20)) & np.uint64(width - 1)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=width) > 0, bitorder="little").view(np.uint64)


class SignatureTree:
    """Levels of (bitmaps, least size, largest size, most doubled tokens).

    Narrow bitmaps are repeated to the widest one's width; a token's bit is
    its hash modulo the width, so they then have all bits a wide one would.
    """

    def __init__(self, bitmaps: list[np.ndarray], sizes: list[int], held: list[int] | None = None) -> None:
        """``held``: how many tokens of each set its bitmap has, if not all; the others are in no other set."""
        size = np.array(sizes, np.int64)
        doubled = (size if held is None else np.array(held, np.int64)) - np.array([int(np.bitwise_count(x).sum()) for x in bitmaps], np.int64)
        words = max((len(x) for x in bitmaps), default=1)
        bitmap = np.empty((len(bitmaps), words), np.uint64)
        for row, x in zip(bitmap, bitmaps, strict=True):
            row.reshape(-1, len(x))[:] = x
        self.levels = [(bitmap, size, size, doubled)]
        while len(self.levels[-1][1]) > 1:
            bitmap, small, large, doubled = self.levels[-1]
            cuts = np.arange(0, len(small), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmap, cuts, axis=0), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts), np.maximum.reduceat(doubled, cuts)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a pair of sets that is similar enough."""
    bits_a, least_a, most_a, doubled_a = a
    bits_b, least_b, most_b, doubled_b = b
    ok = (4 * most_a[i] >= 3 * least_b[j]) & (4 * most_b[j] >= 3 * least_a[i])
    at = np.flatnonzero(ok)
    step = max(1, BLOCK // bits_a.shape[1])
    for k in range(0, len(at), step):
        s = at[k : k + step]
        shared = np.bitwise_count(bits_a[i[s]] & bits_b[j[s]]).sum(axis=1).astype(np.int64) + np.minimum(doubled_a[i[s]], doubled_b[j[s]])
        shared = np.minimum(shared, np.minimum(most_a[i[s]], most_b[j[s]]))
        ok[s] = 7 * shared >= 3 * (least_a[i[s]] + least_b[j[s]])
    return ok


def spanning_links(
    keys: list[int],
    bitmaps: list[np.ndarray],
    sizes: list[int],
    order_by: list[tuple[int, int]],
    sets: list[np.ndarray] | None = None,
    side: list[int] | None = None,
    known: list[int] | None = None,
) -> list[tuple[int, int]]:
    """Links that join all sets which similar pairs connect, as key pairs.

    Without ``sets`` the pairs are those that may be similar by their bitmaps,
    a superset.  ``sets`` and bitmaps may leave out tokens of no other set, which
    ``sizes`` count.  ``side`` 0 and 1: only pairs across the sides are compared.
    ``known`` names the component a set is already known to be in; pairs
    inside one are not compared again.
    """
    n = len(keys)
    order = sorted(range(n), key=lambda i: (len(bitmaps[i]), order_by[i], sizes[i]))
    pick = lambda x: [x[i] for i in order] if x is not None else None
    keys, sets, side, sizes = pick(keys), pick(sets), pick(side), pick(sizes)
    tree = SignatureTree(pick(bitmaps), sizes, [len(x) for x in sets] if sets is not None else None)
    bottom = tree.levels[0]
    forest, links = Forest(), []
    if known:
        first: dict[int, int] = {}
        for at, i in enumerate(order):
            forest.join(at, first.setdefault(known[i], at))

    def similar(i: int, j: int) -> bool:
        if sets is not None:
            return enough(common(sets[i], sets[j]), sizes[i], sizes[j])
        return bool(_possible(bottom, bottom, np.array([i]), np.array([j]))[0])

    def link(i: int, j: int) -> bool:
        if forest.root(i) == forest.root(j):
            return True
        if similar(i, j):
            forest.join(i, j)
            links.append((keys[i], keys[j]))
            return True
        return False

    if not side:
        # neighbours in this order mostly are copies; that settles most sets before the traversal
        leader = 0
        for i in range(1, n):
            if not link(leader, i) and not link(i - 1, i):
                leader = i
    sides = np.array(side or [0] * n)
    uniform: dict[int, tuple] = {}
    made = -1
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), False)]
    while stack:
        depth, i, j, parents = stack.pop()
        if parents:  # opened only now, which bounds what waits
            i, j = (i[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel(), (j[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            inside = (i < len(tree.levels[depth][1])) & (j < len(tree.levels[depth][1])) & (i <= j)
            i, j = i[inside], j[inside]
        if made != len(links):  # links since the last look may have settled more nodes
            made, uniform = len(links), {}
            roots = np.array([forest.root(x) for x in range(n)])
        if depth not in uniform:
            cuts = np.arange(0, n, FAN**depth)
            ends = lambda x: (np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts))  # noqa: E731, B023
            uniform[depth] = *ends(roots), *ends(sides)
        low, high, down, up = uniform[depth]
        # nodes whose sets are all in one component, or all on one side, need no look at their like
        settled = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
        if side:
            settled |= (down[i] == up[i]) & (down[j] == up[j]) & (down[i] == down[j])
        i, j = i[~settled], j[~settled]
        ok = _possible(tree.levels[depth], tree.levels[depth], i, j)
        i, j = i[ok], j[ok]
        if not depth:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if a != b and not (side and side[a] == side[b]):
                    link(a, b)
            continue
        stack += [(depth - 1, i[s : s + PAIRS], j[s : s + PAIRS], True) for s in range(0, len(i), PAIRS)]
    return links
