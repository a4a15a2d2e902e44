"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

A node has a vantage point and a radius. For a limit r on the distance of a pair, its inner side
takes the points within radius + r, its outer side those beyond the radius: by the triangle bound
two points within r of each other meet in at least one side, so every such pair meets in some leaf.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Points below which pairs are compared directly.
DIRECT = 512
#: Pairs compared at a time.
BLOCK = 1 << 19


def masks(r: int) -> list[np.uint64]:
    """All choices of r of the eight bytes of a fingerprint."""
    return [np.uint64(sum(0xFF << 8 * b for b in chosen)) for chosen in combinations(range(8), min(r, 8))]


def distances(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def build(sample: np.ndarray, depth: int, r: int) -> list[tuple[int, int, int, int]]:
    """A tree of at most depth levels as rows (vantage, radius, inner, outer); a child below zero is leaf number -child - 1."""
    rows: list[list[int]] = []
    leaves = 0

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    def grow(points: np.ndarray, level: int) -> int:
        if level == 0 or len(points) < 8:
            return leaf()
        best = None
        for vantage in points[:: max(1, len(points) // 8)][:8]:
            d = distances(points, vantage)
            radius = int(np.sort(d)[len(d) // 2])
            for cut in (radius - 1, radius):
                inner, outer = int((d <= cut + r).sum()), int((d > cut).sum())
                if best is None or max(inner, outer) < best[0]:
                    best = (max(inner, outer), inner + outer, int(vantage), cut, d)
        most, both, vantage, radius, d = best
        # a vantage point that parts little, or has most points on both sides, costs more than it saves
        if most > 0.95 * len(points) or both > 1.5 * len(points):
            return leaf()
        at = len(rows)
        rows.append([vantage, radius, 0, 0])
        rows[at][2] = grow(points[d <= radius + r], level - 1)
        rows[at][3] = grow(points[d > radius], level - 1)
        return at

    root = grow(np.asarray(sample, dtype=np.uint64), depth)
    return [tuple(x) for x in rows] if root >= 0 else []


def shards(tree: list[tuple[int, int, int, int]], points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index of point) for each leaf that a point must be in."""
    if not tree:
        return np.zeros(len(points), dtype=np.int64), np.arange(len(points))
    out = []
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, index = stack.pop()
        if not len(index):
            continue
        if node < 0:
            out.append((np.full(len(index), -node - 1, dtype=np.int64), index))
            continue
        vantage, radius, inner, outer = tree[node]
        d = distances(points[index], vantage)
        stack += [(inner, index[d <= radius + r]), (outer, index[d > radius])]
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of the component of each of n points under the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(points: np.ndarray, r: int) -> np.ndarray:
    """For each of distinct points the index of the least point of its component under distance r, by a local tree."""
    a_all, b_all = [], []
    stack = [np.arange(len(points))]
    while stack:
        index = stack.pop()
        own = points[index]
        if len(own) > DIRECT:
            best = None
            for vantage in own[:: len(own) // 4][:4]:
                d = distances(own, vantage)
                radius = int(np.sort(d)[len(d) // 2])
                for cut in (radius - 1, radius):
                    inner, outer = int((d <= cut + r).sum()), int((d > cut).sum())
                    if best is None or max(inner, outer) < best[0]:
                        best = (max(inner, outer), inner + outer, cut, d)
            most, both, cut, d = best
            if most <= 0.8 * len(own) and both <= 1.5 * len(own):
                stack += [index[d <= cut + r], index[d > cut]]
                continue
        step = max(1, BLOCK // max(1, len(own)))
        label = np.arange(len(own))
        for i in range(0, len(own), step):
            near = np.bitwise_count(own[i : i + step, None] ^ own[None, :]) <= r
            x, y = np.nonzero(near)
            up = y > x + i
            label = _settle(len(own), np.concatenate([x[up] + i, np.arange(len(own))]), np.concatenate([y[up], label]))
        moved = label != np.arange(len(own))
        a_all.append(index[moved])
        b_all.append(index[label[moved]])
    if not a_all:
        return np.arange(len(points))
    return _settle(len(points), np.concatenate(a_all), np.concatenate(b_all))
