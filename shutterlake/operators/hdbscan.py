"""Hierarchical density clustering (Campello, Moulavi and Sander 2013), in numpy."""

from __future__ import annotations

import numpy as np


def _spanning_tree(core: np.ndarray, distance) -> list[tuple[float, int, int]]:
    """Edges (height, lesser row, greater row) of the minimum spanning tree of mutual reachability, by Prim's method.

    Equal heights are in the order of their rows, so that there is one such tree only.
    """
    n = len(core)
    near, parent = np.full(n, np.inf), np.zeros(n, int)
    left, rows = np.ones(n, bool), np.arange(n)
    pair = lambda i: np.minimum(i, rows) * n + np.maximum(i, rows)
    at, edges = 0, []
    for _ in range(n - 1):
        left[at] = False
        reach = np.maximum(np.maximum(distance(at), core), core[at])
        closer = left & ((reach < near) | ((reach == near) & (pair(at) < pair(parent))))
        near[closer], parent[closer] = reach[closer], at
        open_ = np.where(left, near, np.inf)
        ties = np.flatnonzero(open_ == open_.min())
        at = int(ties[pair(parent)[ties].argmin()])
        edges.append((float(near[at]), min(int(parent[at]), at), max(int(parent[at]), at)))
    return edges


def spanning_tree(n: int, nearest) -> list[tuple[float, int, int]]:
    """The same tree by Boruvka's method; nearest(rows, part) gives the height and the row of the least edge from each of
    the rows (a mask) to another part, the lesser row at equal heights.

    Parts only grow, so an edge found before is still the least if it leads to another part, and else a lower bound:
    only rows that may have their part's least edge are asked again.
    """
    part, height, to = np.arange(n), np.zeros(n), np.full(n, -1)
    edges: list[tuple[float, int, int]] = []
    while len(edges) < n - 1:
        known = (to >= 0) & (part[to] != part)
        least = np.full(n, np.inf)
        np.minimum.at(least, part[known], height[known])
        ask = ~known & (height <= least[part])
        if ask.any():
            height[ask], to[ask] = nearest(ask, part)
        rows = np.flatnonzero((to >= 0) & (part[to] != part) & (height < np.inf))
        low, high = np.minimum(rows, to[rows]), np.maximum(rows, to[rows])
        order = np.lexsort((high, low, height[rows], part[rows]))
        first = order[np.unique(part[rows][order], return_index=True)[1]]
        new = {(float(height[rows[i]]), int(low[i]), int(high[i])) for i in first}
        if not new:
            raise ValueError("vectors must be finite")
        edges += new
        root = np.arange(n)

        def top(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return int(i)

        for _, i, j in new:
            root[top(int(part[i]))] = top(int(part[j]))
        while (root != root[root]).any():
            root = root[root]
        part = root[part]
    return edges


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def labels(vectors: np.ndarray, min_cluster_size: int) -> np.ndarray:
    """Cluster of each row by cosine distance, numbered by first member; -1 is noise. One single cluster is none."""
    x = unit(vectors)
    n = len(x)
    distance = lambda i: np.clip(1 - x @ x[i], 0, 2)
    k = min(min_cluster_size, n)
    core = np.array([np.partition(distance(i), k - 1)[k - 1] for i in range(n)])
    return tree_labels(n, _spanning_tree(core, distance), min_cluster_size)


def tree_labels(n: int, edges: list[tuple[float, int, int]], min_cluster_size: int) -> np.ndarray:
    """The labels that follow from the edges of a spanning tree."""
    # The dendrogram of single linkage: node n + i joins two nodes at a height.
    root, size, node = list(range(n)), [1] * n + [0] * (n - 1), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    joins = []
    for i, (height, a, b) in enumerate(sorted(edges)):
        a, b = find(a), find(b)
        joins.append((node[a], node[b], height))
        size[n + i] = size[node[a]] + size[node[b]]
        root[b], node[a] = a, n + i

    # The leaves in an order in which those of every node are next to one another.
    start = [0] * (2 * n - 1)
    for t in range(2 * n - 2, n - 1, -1):
        a, b, _ = joins[t - n]
        start[a], start[b] = start[t], start[t] + size[a]
    order = np.empty(n, int)
    order[start[:n]] = np.arange(n)

    # Condensed tree: a cluster lives until it splits into two large enough parts; stability sums its members' lives.
    parent, birth, stability, held = [-1], [0.0], [0.0], [2 * n - 2]
    stack = [(2 * n - 2, 0)]
    while stack:
        t, c = stack.pop()
        if t < n:
            continue
        a, b, height = joins[t - n]
        rate = 1 / height if height > 0 else np.finfo(float).max ** 0.5
        big = [s for s in (a, b) if size[s] >= min_cluster_size]
        if len(big) == 2:
            stability[c] += size[t] * (rate - birth[c])
            for s in big:
                parent.append(c)
                birth.append(rate)
                stability.append(0.0)
                held.append(s)
                stack.append((s, len(parent) - 1))
        else:
            for s in (a, b):
                if s in big:
                    stack.append((s, c))
                else:
                    stability[c] += size[s] * (rate - birth[c])
    # Excess of mass, from the last clusters to the first; the root is never chosen.
    chosen, best = [False] * len(parent), list(stability)
    below = [0.0] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = stability[c] >= below[c]
        best[c] = max(stability[c], below[c])
        below[parent[c]] += best[c]
    out = np.full(n, -1)
    for c in range(len(parent) - 1, 0, -1):
        above, p = False, parent[c]
        while p > 0:
            above |= chosen[p]
            p = parent[p]
        if chosen[c] and not above:
            out[order[start[held[c]] : start[held[c]] + size[held[c]]]] = c
    _, first = np.unique(out[out >= 0], return_index=True)
    names = out[out >= 0][np.sort(first)]
    number = {int(c): i for i, c in enumerate(names)}
    return np.array([number.get(int(c), -1) for c in out], np.int32)
