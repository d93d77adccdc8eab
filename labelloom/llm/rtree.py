"""An R-tree over count vectors that joins a tile of sets with itself.

The shingles of a set are hashed into groups; the counts per group are its point. Two sets share at most the
sum over groups of the smaller count, and a set shares at most the sum of minima with the upper corner of a
box with any set in that box. Boxes whose bound is below the overlap that linking needs are not entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from labelloom.llm.shingles import least_overlap, overlap

GROUPS = 64
# More groups from so many shingles per group on.
GROUP_SHINGLES = 12
FANOUT = 16


def groups_for(size: int) -> int:
    """Groups of a set: a power of two, so that unrelated sets differ by more than chance evens out in any size.

    Two unrelated sets of n shingles differ by about 0.6 sqrt(n G) over G groups, and a link allows a share of n.
    """
    groups = GROUPS
    while groups * GROUP_SHINGLES < size:
        groups *= 2
    return groups


def count_point(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Counts per group of a set, taken from high bits, which other steps do not use."""
    return np.bincount(((hashes >> np.uint64(40)) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def count_points(sets: list[np.ndarray], groups: int | None = None) -> np.ndarray:
    """Points of sets over the same groups, as many as the largest set needs."""
    groups = groups or groups_for(max(map(len, sets), default=0))
    return np.array([count_point(s, groups) for s in sets], dtype=np.int32).reshape(len(sets), groups)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points over different numbers of groups, brought to the smallest one; groups nest."""
    least = min(map(len, points))
    return np.array([p.reshape(-1, least).sum(axis=0) for p in points], dtype=np.int32)


class RTree:
    """Bulk-loaded: points are cut at the median of the widest coordinate (sizes first) down to leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order: list[np.ndarray] = []

        def cut(rows: np.ndarray) -> None:
            if len(rows) <= FANOUT:
                order.append(rows)
                return
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            by_size = int(sizes[rows].max() - sizes[rows].min()) > 2 * int(spread.max())
            values = sizes[rows] if by_size else points[rows, int(spread.argmax())]
            ranked = rows[np.argsort(values, kind="stable")]
            half = -(-len(rows) // (2 * FANOUT)) * FANOUT
            cut(ranked[:half])
            cut(ranked[half:])

        cut(np.arange(len(sizes)))
        # Levels of boxes from the leaves up: children, upper corner, smallest and largest size.
        self.levels: list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]] = []
        upper, low, high = points, sizes, sizes
        children = order
        while True:
            upper = np.array([upper[c].max(axis=0) for c in children])
            low = np.array([low[c].min() for c in children])
            high = np.array([high[c].max() for c in children])
            self.levels.append((children, upper, low, high))
            if len(children) <= FANOUT:
                break
            numbers = np.arange(len(children))
            children = [numbers[i : i + FANOUT] for i in range(0, len(numbers), FANOUT)]

    def candidates(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose bound reaches the overlap that linking with a set of ``size`` needs."""
        boxes = np.arange(len(self.levels[-1][0]))
        for children, upper, low, high in reversed(self.levels):
            bound = np.minimum(point, upper[boxes]).sum(axis=1)
            fits = (bound >= least_overlap(size + low[boxes], percent)) & (100 * high[boxes] >= percent * size)
            fits &= percent * low[boxes] <= 100 * size
            boxes = boxes[fits]
            if not len(boxes):
                return boxes
            boxes = np.concatenate([children[b] for b in boxes])
        bound = np.minimum(point, self.points[boxes]).sum(axis=1)
        return boxes[bound >= least_overlap(size + self.sizes[boxes], percent)]


def link_tile(
    sets: list[np.ndarray], labels: np.ndarray, percent: int, sides: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links between rows that join different labels; enough of them to connect all that link.

    Pairs that already have one label are not looked at, so a group of copies costs about one check per
    row. ``sides`` 1 and 2 limit the pairs to one row of each; rows of side 0 may pair with any.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    points = count_points(sets)
    labels = labels.copy()
    sides = np.zeros(len(sets), dtype=np.int64) if sides is None else sides
    first, second = np.flatnonzero(sides < 2), np.flatnonzero(sides > 0)
    if not len(second):
        second = first
    tree = RTree(points[second], sizes[second])
    links: list[tuple[int, int]] = []
    for i in first:
        found = second[tree.candidates(points[i], int(sizes[i]), percent)]
        found = found[(labels[found] != labels[i]) & ((found < i) | (sides[i] > 0))]
        while len(found):
            j = int(found[0])
            if overlap(sets[i], sets[j]) >= least_overlap(int(sizes[i] + sizes[j]), percent):
                links.append((int(i), j))
                labels[labels == labels[j]] = labels[i]
            found = found[1:][labels[found[1:]] != labels[i]]
    return links


def linked_pairs(sets: list[np.ndarray], percent: int, sides: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows that it links with, shared elements of each): every pair that links, once.

    ``sides`` as in ``link_tile``. Nothing is inferred from other links; all candidates are verified.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    points = count_points(sets)
    first, second = np.flatnonzero(sides < 2), np.flatnonzero(sides != 1)
    if not len(first) or not len(second):
        return
    tree = RTree(points[second], sizes[second])
    for i in first:
        found = second[tree.candidates(points[i], int(sizes[i]), percent)]
        found = found[(found < i) | (sides[i] > 0)]
        if not len(found):
            continue
        others = np.concatenate([sets[j] for j in found])
        at = np.searchsorted(sets[i], others)
        at[at == len(sets[i])] = 0
        ends = np.cumsum(sizes[found])
        shared = np.add.reduceat((sets[i][at] == others).astype(np.int64), ends - sizes[found])
        links = shared >= least_overlap(sizes[i] + sizes[found], percent)
        if links.any():
            yield int(i), found[links], shared[links]


def near_points(points: np.ndarray, sizes: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the rows: it connects all that pairs within the bound connect.

    Rows of side 1 are paired with rows of side 2; without sides all rows are paired.
    """
    labels = np.arange(len(sizes))
    first, second = np.flatnonzero(sides < 2), np.flatnonzero(sides != 1)
    tree = RTree(points[second], sizes[second])
    edges: list[tuple[int, int]] = []
    for i in first:
        found = second[tree.candidates(points[i], int(sizes[i]), percent)]
        for label in np.unique(labels[found]):
            if label != labels[i]:
                edges.append((int(i), int(found[labels[found] == label][0])))
                labels[labels == label] = labels[i]
    return edges
