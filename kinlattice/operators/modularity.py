"""Greedy modularity of one weighted graph, in arrays: what one task does with one connected component."""

from __future__ import annotations

import heapq
from array import array

import numpy as np

#: Gains are compared as whole numbers of this size, so that sums in another order do not change a tie.
DIGIT = 1e-12
#: Edges looked at together (or as many as there are nodes, if more), so that what lies beside the graph stays small.
BLOCK = 1 << 18


def extended(kept, n: int, more):
    """``kept`` with ``more`` from place ``n`` on. Its room is doubled where needed; room that is not written to takes no memory."""
    end = n + len(more)
    if end > len(kept):
        old, kept = kept, np.empty(max(end, 2 * len(kept)), dtype=kept.dtype)
        kept[:n] = old[:n]
    kept[n:end] = more
    return kept


class Graph:
    """Nodes 0..n-1 in the order that decides ties, and their neighbours as one array sliced by node."""

    def __init__(self, n: int, a, b, w):
        self.n, self.total = n, float(w.sum())
        self.step = max(BLOCK, n)
        self.degree = np.bincount(a, w, n) + np.bincount(b, w, n)
        sizes = np.zeros(n, dtype=np.int64)
        for src, _, _ in self._ends(a, b, w):
            sizes += np.bincount(src, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.near, self.weight = np.empty(self.start[-1], dtype=np.int32), np.empty(self.start[-1])
        free = self.start[:-1].copy()
        for src, dst, weight in self._ends(a, b, w):
            order = np.argsort(src, kind="stable")
            src, count = src[order], np.bincount(src, minlength=n)
            at = (free + count - np.cumsum(count))[src] + np.arange(len(src))
            self.near[at], self.weight[at] = dst[order], weight[order]
            free += count

    def _ends(self, a, b, w):
        for src, dst in ((a, b), (b, a)):
            for k in range(0, len(w), self.step):
                x, y = src[k : k + self.step], dst[k : k + self.step]
                other = x != y
                yield x[other], y[other], w[k : k + self.step][other]

    def row(self, k: int):
        at = slice(self.start[k], self.start[k + 1])
        return self.near[at], self.weight[at]

    def blocks(self):
        """Nodes and their neighbours, one by one of each node, some nodes at a time."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + self.step, "right")) - 1)
            yield np.repeat(np.arange(lo, hi), np.diff(self.start[lo : hi + 1])), self.near[self.start[lo] : self.start[hi]]
            lo = hi


def merged(g: Graph, resolution: float):
    """The cluster of each node, as some node of it: the best merge first, ties by the least node of either side.

    Each pair of clusters is covered by a row, at first that of the end with more neighbours, later that of the
    last merge. A heap has the best pair of each row. Gains rise by a merge only, and a merge makes its row
    anew, so what the heap has of other rows is never too low; a row is made anew where its best pair is at
    the top and has changed. Work is thus by rows, not by the pairs that a merge changes. A row is kept beside
    the graph's own only if it was merged or has become half as long.
    """
    n, total = g.n, g.total
    cluster = np.arange(n)
    if not total:
        return cluster
    degree, rank = g.degree.copy(), np.arange(n)
    sizes = np.diff(g.start)
    rows: dict = {}
    members: dict = {}
    made, changed, count = np.full(n, -1), np.full(n, -1), 0
    heap: list = []

    def renew(s):
        nonlocal count
        near, weight = rows[s] if s in rows else g.row(s)
        near, long = cluster[near], len(near)
        if 16 * len(near) > n:
            dense = np.bincount(near, weight, n)
            dense[s] = 0
            near = np.flatnonzero(dense)
            weight = dense[near]
        else:
            near, at = np.unique(near, return_inverse=True)
            weight = np.bincount(at, weight, len(near))
            keep = near != s
            near, weight = near[keep], weight[keep]
        if s in rows or 2 * len(near) <= long:
            rows[s] = near.astype(np.int32), weight
        count += 1
        made[s] = count
        if not len(near):
            return
        gain = np.rint((weight / total - resolution * degree[s] * degree[near] / (2 * total * total)) / DIGIT)
        best = gain.max()
        if best > 0:
            ties = near[gain == best]
            t = int(ties[rank[ties].argmin()])
            lo, hi = sorted((int(rank[s]), int(rank[t])))
            heapq.heappush(heap, (-best, lo, hi, count, s, t))

    first = np.zeros(n, dtype=bool)
    for src, near in g.blocks():
        more = sizes[src] - sizes[near]
        first[src[(more > 0) | ((more == 0) & (src < near))]] = True
    for s in np.flatnonzero(first).tolist():
        renew(s)
    while heap:
        _, _, _, at, s, t = heapq.heappop(heap)
        if made[s] != at or cluster[s] != s:
            continue
        if cluster[t] != t or changed[t] > at:
            renew(s)
            continue
        x, y = (rows[k] if k in rows else g.row(k) for k in (s, t))
        if len(x[0]) < len(y[0]):
            s, t = t, s
        rows[s] = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
        rows.pop(t, None)
        joined = members.pop(t, None) or array("i", [t])
        cluster[np.array(joined)] = s
        members.setdefault(s, array("i", [s])).extend(joined)
        degree[s] += degree[t]
        rank[s] = min(rank[s], rank[t])
        changed[s] = count + 1
        renew(s)
    return cluster


def moved(g: Graph, cluster, resolution: float, order):
    """``cluster`` (a node of it for each node) after moves of single nodes in ``order`` to the neighbouring cluster of largest gain, until none moves.

    Of equal gains the least cluster is taken.
    """
    n, total = g.n, g.total
    cluster = cluster.copy()
    size = np.bincount(cluster, g.degree, n)
    again = True
    while again:
        again = False
        for k in order:
            near, weight = g.row(k)
            if not len(near):
                continue
            to, at = np.unique(cluster[near], return_inverse=True)
            to_weight = np.bincount(at, weight, len(to))
            here, own = cluster[k], g.degree[k]
            size[here] -= own
            gain = to_weight / total - resolution * own * size[to] / (2 * total * total)
            best = int(gain.argmax())
            there = to[best]
            if there != here:
                stay = np.searchsorted(to, here)
                inside = to_weight[stay] if stay < len(to) and to[stay] == here else 0.0
                if gain[best] > inside / total - resolution * own * size[here] / (2 * total * total) + 1e-12:
                    cluster[k], again = there, True
            size[cluster[k]] += own
    return cluster


def connected(g: Graph, cluster):
    """The least node of each node's part: of those that edges within its cluster connect with it."""
    root = np.arange(g.n)
    again = True
    while again:
        again = False
        for src, near in g.blocks():
            inner = cluster[src] == cluster[near]
            x, y = root[src[inner]], root[near[inner]]
            apart = x != y
            if not apart.any():
                continue
            again, x, y = True, x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def named(cluster, key):
    """``cluster`` with each cluster as its node of least ``key`` (a number for each node, none twice)."""
    by = np.lexsort([key, cluster])
    first = np.concatenate([[True], cluster[by][1:] != cluster[by][:-1]])
    name = np.empty(len(cluster), dtype=np.int64)
    name[cluster[by][first]] = by[first]
    return name[cluster]
