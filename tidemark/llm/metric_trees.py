"""Metric trees over integer points by the anchors hierarchy, and nearest-entry sums over them.

Anchors: the point furthest from its anchor becomes the next one and takes over the points that are nearer to it; the
triangle inequality spares it those that can't be.  About sqrt(n) anchors are merged into balls two by two, smallest
ball first, and each anchor's points are cut in the same way until few are left: the tree grows from its middle.  Every
ball keeps the sum and the count of its points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 24
#: Squared distances of points below this fit 64 bits for any usual number of columns; larger ones are Python integers.
SMALL = 1 << 26


def integers(values: np.ndarray) -> np.ndarray:
    """As 64-bit integers where squared distances fit these, else as Python integers, which have no bound."""
    small = values.size == 0 or (np.abs(values) < SMALL).all() and values.shape[-1] <= 512
    return values.astype(np.int64) if small else values.astype(object)


@dataclass
class MetricTree:
    """Balls in the order of their depth; the points of ball i are rows first[i] to last[i] of `points`."""

    points: np.ndarray  # in tree order
    order: np.ndarray  # row of the input of each
    left: np.ndarray  # child or -1
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    @property
    def pivots(self) -> np.ndarray:
        return self.sums / np.maximum(self.last - self.first, 1)[:, None]


def _gaps(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(1))


def anchors(points: np.ndarray, wanted: int) -> np.ndarray:
    """Anchor that owns each point; fewer than `wanted` where there are fewer distinct points."""
    n = len(points)
    owner, gap = np.zeros(n, np.int64), _gaps(points, points[0])
    places = [0]
    while len(places) < wanted:
        far = int(np.argmax(gap))
        if gap[far] == 0:
            break
        between = _gaps(points[places], points[far])
        near = np.flatnonzero(gap * 2 >= between[owner] * (1 - 1e-9))  # nobody else can be nearer to the new one
        new = _gaps(points[near], points[far])
        taken = near[new < gap[near]]
        gap[taken], owner[taken] = new[new < gap[near]], len(places)
        places.append(far)
    return owner


class _Build:
    def __init__(self, points: np.ndarray):
        self.points, self.exact = points.astype(np.float64), points
        self.nodes: list[tuple[int, int, np.ndarray | None]] = []  # left, right, rows of a leaf

    def node(self, rows: np.ndarray) -> int:
        """A ball over `rows`, by anchors where they are many."""
        points = self.points[rows]
        if len(rows) <= LEAF or (points == points[0]).all():
            self.nodes.append((-1, -1, rows))
            return len(self.nodes) - 1
        owner = anchors(points, max(2, int(np.sqrt(len(rows)))))
        groups = [rows[owner == a] for a in range(owner.max() + 1)]
        return self._merged(groups)

    def _merged(self, groups: list[np.ndarray]) -> int:
        """Pairs whose common ball would be smallest are joined until one is left."""
        at = [self.node(g) for g in groups]
        count = np.array([len(g) for g in groups], np.float64)
        centre = np.array([self.points[g].mean(0) for g in groups])
        radius = np.array([_gaps(self.points[g], c).max() for g, c in zip(groups, centre)])
        n = len(groups)
        size = np.full((n, n), np.inf)
        for i in range(n):
            size[i, i + 1 :] = (_gaps(centre[i + 1 :], centre[i]) + radius[i] + radius[i + 1 :]) / 2
        for _ in range(n - 1):
            i, j = divmod(int(np.argmin(size)), n)
            self.nodes.append((at[i], at[j], None))
            at[i] = len(self.nodes) - 1
            both = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
            radius[i] = max(radius[k] + float(np.sqrt(((centre[k] - both) ** 2).sum())) for k in (i, j))
            centre[i], count[i] = both, count[i] + count[j]
            size[j], size[:, j] = np.inf, np.inf
            new = (_gaps(centre, both) + radius[i] + radius) / 2
            alive = np.isfinite(size[i]) | np.isfinite(size[:, i])
            size[i, i + 1 :] = np.where(alive[i + 1 :], new[i + 1 :], np.inf)
            size[:i, i] = np.where(alive[:i], new[:i], np.inf)
        return at[0] if n == 1 else len(self.nodes) - 1

    def tree(self) -> MetricTree:
        n, width = self.points.shape
        root = self.node(np.arange(n))
        order: list[np.ndarray] = []
        depth_first: list[int] = []
        first, last = {}, {}
        stack, at = [(root, False)], 0
        while stack:
            i, done = stack.pop()
            left, right, rows = self.nodes[i]
            if rows is not None:
                first[i], last[i] = at, at + len(rows)
                at += len(rows)
                order.append(rows)
                depth_first.append(i)
            elif done:
                first[i], last[i] = first[left], last[right]
                depth_first.append(i)
            else:
                stack += [(i, True), (right, False), (left, False)]
        level, ranked = [root], []
        while level:
            ranked += level
            level = [c for i in level for c in self.nodes[i][:2] if c >= 0]
        number = {i: k for k, i in enumerate(ranked)} | {-1: -1}
        order_of = np.concatenate(order)
        exact = self.exact[order_of]
        # Sums and radii of balls from prefix sums and from the points themselves.
        start = np.array([first[i] for i in ranked])
        end = np.array([last[i] for i in ranked])
        before = np.concatenate([np.zeros((1, width), exact.dtype), np.cumsum(exact, axis=0, dtype=exact.dtype)])
        sums = before[end] - before[start]
        pivots = sums.astype(np.float64) / (end - start)[:, None]
        near = self.points[order_of]
        radius = np.array([_gaps(near[a:b], p).max() for a, b, p in zip(start, end, pivots)])
        left, right = (np.array([number[self.nodes[i][side]] for i in ranked], np.int32) for side in (0, 1))
        return MetricTree(exact, order_of, left, right, start, end, sums, radius)


def build(points: np.ndarray) -> MetricTree:
    """Tree of the rows of `points`, one at least, as `integers` gives them."""
    return _Build(points).tree()


def walk(tree: MetricTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each point in tree order, and per entry the sum and the count of its points.

    A ball inherits the candidate entries of the ball above it and drops those that are further from all its points than
    another one.  A ball with one candidate left is owned: its cached sum and count are added as they are.  Points of
    leaves are compared with the candidates left.  Distances are exact, and equal ones go to the lower entry.
    """
    exact = entries.astype(object) if tree.points.dtype == object else integers(entries)
    every = tree.points.astype(exact.dtype)
    largest = max(float(np.abs(a).max()) if a.size else 0.0 for a in (every, exact))
    places, near = entries.astype(np.float64), np.zeros(len(tree.points), np.int64)
    sums, counts = np.zeros((len(entries), entries.shape[1]), exact.dtype), np.zeros(len(entries), np.int64)
    pivots = tree.pivots.astype(np.float64)
    balls, open_entries = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(balls):
        gap = np.sqrt(((pivots[balls, None] - places[None]) ** 2).sum(2))
        gap[~open_entries] = np.inf
        reach = gap.min(1) + 2 * tree.radius[balls]
        slack = 1e-6 + 1e-9 * reach + 1e-12 * largest  # what rounding could hide stays a candidate
        open_entries = gap <= (reach + slack)[:, None]
        owned = open_entries.sum(1) == 1
        for ball, entry in zip(balls[owned].tolist(), open_entries[owned].argmax(1).tolist()):
            near[tree.first[ball] : tree.last[ball]] = entry
            sums[entry] += tree.sums[ball]
            counts[entry] += tree.last[ball] - tree.first[ball]
        leaf = ~owned & (tree.left[balls] < 0)
        if leaf.any():
            size = (tree.last - tree.first)[balls[leaf]]
            rows = np.arange(size.sum()) + np.repeat(tree.first[balls[leaf]] - (np.cumsum(size) - size), size)
            points, among = every[rows], np.repeat(open_entries[leaf], size, axis=0)
            far = ((points[:, None] - exact[None]) ** 2).sum(2)
            top = far.max(initial=0) + 1
            found = np.argmin(np.where(among, far, top), axis=1)
            near[rows] = found
            np.add.at(sums, found, points)
            np.add.at(counts, found, 1)
        inner = ~owned & ~leaf
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
        open_entries = np.concatenate([open_entries[inner], open_entries[inner]])
    return near, sums, counts
