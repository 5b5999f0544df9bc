"""Cover trees over unit vectors and their dual traversal."""

from __future__ import annotations

from math import sqrt

import numpy as np

# Rows whose products with all others are held at a time.
PRODUCT_ROWS = 512


class CoverTree:
    """Nested levels of centres with halving radii.

    Centres are taken farthest first, so every level is a prefix of one order: level l
    holds the centres that were more than ``radius / 2**l`` away from all before them,
    and thus covers all points within that radius. ``parents[l]`` maps the centres of a
    level to those above, ``cover[l]`` is the distance to a centre's farthest descendant.
    Levels end once the radius is below ``finest`` or there are ``most`` centres (where points spread
    evenly more of them prune nothing); the points hang from the last level.
    """

    def __init__(self, points: np.ndarray, finest: float, most: int = 256):
        n = len(points)
        order, reach = [0], []
        nearest = np.linalg.norm(points - points[0], axis=1)
        radius = float(nearest.max(initial=0.0))
        while len(order) < min(n, most) and (far := float(nearest.max())) > finest:
            at = int(nearest.argmax())
            order.append(at)
            reach.append(far)
            np.minimum(nearest, np.linalg.norm(points - points[at], axis=1), out=nearest)
        self.points, self.order = points, np.array(order)
        sizes, bound = [1], radius / 2
        while sizes[-1] < len(order):
            sizes.append(1 + sum(1 for r in reach if r > bound))
            bound /= 2
        self.levels = sorted(set(sizes))
        self.parents = [np.zeros(1, np.int64)]
        for above, size in zip(self.levels, self.levels[1:], strict=False):
            self.parents.append(self._closest(points[self.order[:size]], above))
        self.leaf_of = self._closest(points, self.levels[-1])
        self.cover: list[np.ndarray] = [np.empty(0)] * len(self.levels)
        ancestor = self.leaf_of
        for level in range(len(self.levels) - 1, -1, -1):
            centres = points[self.order[: self.levels[level]]]
            distance = np.linalg.norm(points - centres[ancestor], axis=1)
            self.cover[level] = np.zeros(len(centres))
            np.maximum.at(self.cover[level], ancestor, distance)
            ancestor = self.parents[level][ancestor]

    def _closest(self, points: np.ndarray, size: int) -> np.ndarray:
        return (points @ self.points[self.order[:size]].T).argmax(axis=1)

    def centres(self, level: int) -> np.ndarray:
        return self.points[self.order[: self.levels[level]]]


def close_pairs(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of points whose cosine is at least ``cosine``.

    Both trees are descended together. A pair of nodes stays only if its centres are no
    farther apart than both covering radii and the threshold distance; only points below
    surviving leaf pairs are compared.
    """
    limit = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    alive = np.ones((1, 1), bool)
    at_a = at_b = 0
    while True:
        first, second = a.centres(at_a), b.centres(at_b)
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        squared = 2 - 2 * (first[rows] @ second[columns].T)
        bound = a.cover[at_a][rows][:, None] + b.cover[at_b][columns][None, :] + limit
        kept = np.zeros_like(alive)
        kept[np.ix_(rows, columns)] = alive[np.ix_(rows, columns)] & (squared <= bound**2)
        last_a, last_b = at_a + 1 == len(a.levels), at_b + 1 == len(b.levels)
        if last_a and last_b:
            break
        if not last_a:
            at_a += 1
            kept = kept[a.parents[at_a]]
        if not last_b:
            at_b += 1
            kept = kept[:, b.parents[at_b]]
        alive = kept
    rows = np.flatnonzero(kept.any(axis=1)[a.leaf_of])
    columns = np.flatnonzero(kept.any(axis=0)[b.leaf_of])
    if not len(rows) or not len(columns):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = [], []
    for start in range(0, len(rows), PRODUCT_ROWS):
        mine = rows[start : start + PRODUCT_ROWS]
        linked = (a.points[mine] @ b.points[columns].T >= cosine) & kept[np.ix_(a.leaf_of[mine], b.leaf_of[columns])]
        p, q = np.nonzero(linked)
        x.append(mine[p])
        y.append(columns[q])
    return np.concatenate(x), np.concatenate(y)
