"""Links between fingerprints of one bucket: a hierarchy of masks in Gray order.

Fingerprints are rows of 64-bit lanes.  Sorted by their rank in the reflected
Gray code, neighbours differ in few bits.  A node of the hierarchy stands for a
run of them and holds the bits they share: a mask and the pattern under it.  Two
nodes differ at least in the bits where both masks hold and the patterns do not
agree; beyond the radius the whole pair of groups is pruned.  Upper nodes share
fewer bits, so differences accumulate on the way down.  Groups that are already
in one component are pruned too: only links that join components are returned,
fewer than there are fingerprints, and no link between components is missed.
"""

from __future__ import annotations

import numpy as np

#: children of a node, and node pairs that are looked at together
FAN, PAIRS = 32, 256
#: groups up to this size are compared directly
SMALL = 48


def gray_rank(lanes: np.ndarray) -> np.ndarray:
    """Rank of each row in the reflected Gray code, again as lanes."""
    out, parity = np.empty_like(lanes), np.zeros(len(lanes), np.uint64)
    for k in range(lanes.shape[1]):
        x = lanes[:, k].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(shift)
        x ^= np.uint64(0) - parity  # an odd number of ones before turns the lane round
        out[:, k] = x
        parity = x & np.uint64(1)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class Components:
    """Union-find over row numbers that remembers the links which joined."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def _find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Add links; of many between the same two components one is enough."""
        if not len(a):
            return
        label = self.labels()
        x, y = label[a], label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        x, y = x[apart], y[apart]
        _, first = np.unique(np.minimum(x, y) * len(label) + np.maximum(x, y), return_index=True)
        for k in first.tolist():
            i, j = self._find(int(x[k])), self._find(int(y[k]))
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                self.links.append((int(a[apart[k]]), int(b[apart[k]])))


class Level:
    """Shared bits of runs of consecutive rows (or nodes)."""

    def __init__(self, ones: np.ndarray, some: np.ndarray, step: int):
        starts = np.arange(0, len(ones), FAN)
        self.ones = np.bitwise_and.reduceat(ones, starts, axis=0)
        self.some = np.bitwise_or.reduceat(some, starts, axis=0)
        self.mask = ~(self.ones ^ self.some)
        self.pattern = self.ones & self.mask
        self.rows = np.arange(0, len(ones) * step, FAN * step)  # first fingerprint of each node

    def near(self, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        return np.bitwise_count((self.pattern[a] ^ self.pattern[b]) & self.mask[a] & self.mask[b]).sum(axis=-1, dtype=np.int32) <= radius

    def apart(self, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether two nodes are not yet known to be one component."""
        low, high = np.minimum.reduceat(label, self.rows), np.maximum.reduceat(label, self.rows)
        return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])


def search(lanes: np.ndarray, radius: int, found: Components, base: int) -> None:
    """Join all components of ``lanes`` (in Gray order) that have a link within ``radius``."""
    n = len(lanes)
    own = lambda: found.labels()[base : base + n]
    for step in (1, 2, 4, 8, 16):  # near neighbours in Gray order first: later pruning lives on it
        if step < n:
            at = np.flatnonzero(distance(lanes[:-step], lanes[step:]) <= radius)
            found.join(base + at, base + at + step)
    levels = [Level(lanes, lanes, 1)]
    while len(levels[-1].ones) > FAN:
        levels.append(Level(levels[-1].ones, levels[-1].some, FAN ** len(levels)))
    a, b = np.triu_indices(len(levels[-1].ones))
    todo = [(len(levels) - 1, a, b)]
    fan = np.arange(FAN)
    while todo:
        depth, a, b = todo.pop()
        if len(a) > PAIRS:
            todo.append((depth, a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        keep = levels[depth].near(a, b, radius)
        keep &= levels[depth].apart(a, b, own())
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        size = n if depth == 0 else len(levels[depth - 1].ones)
        x = np.broadcast_to((a[:, None] * FAN + fan)[:, :, None], (len(a), FAN, FAN)).ravel()
        y = np.broadcast_to((b[:, None] * FAN + fan)[:, None, :], (len(a), FAN, FAN)).ravel()
        fits = (x < size) & (y < size) & ((x < y) | ((x == y) & (depth > 0)))
        x, y = x[fits], y[fits]
        if depth:
            todo.append((depth - 1, x, y))
            continue
        close = distance(lanes[x], lanes[y]) <= radius
        found.join(base + x[close], base + y[close])


def bucket_links(group: np.ndarray, lanes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Row pairs that join all components inside each group; ``group`` ascends."""
    rank = gray_rank(lanes)
    order = np.lexsort([*rank.T[::-1], group])
    group, lanes = group[order], lanes[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    found = Components(len(group))
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    for step in range(1, SMALL):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        close = at[distance(lanes[at], lanes[at + step]) <= radius]
        found.join(close, close + step)
    for k in np.flatnonzero(sizes > SMALL).tolist():
        search(lanes[starts[k] : starts[k] + sizes[k]], radius, found, int(starts[k]))
    return [(int(order[i]), int(order[j])) for i, j in found.links]
