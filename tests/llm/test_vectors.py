"""Vector codes against brute force in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import metric_trees, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    w = width // parts
    cut = [[r[1][p * w : p * w + w] for p in range(parts)] for r in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, b in zip(cut, best) if b[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    best = assign()
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in b) for b in best]
    label = {}
    for r, e in zip(kept, error):
        label[r[2]] = label.get(r[2], 0) + e
    return [(r[0], "".join(f"{k:02x}" for _, k in b), e, label[r[2]] if label[r[2]] < 2**63 else None, name) for r, b, e in zip(kept, best, error)]


def drawn(n, width=16, seed=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(middles)], rng.choice([1, 2, 2, 2, None])) for i in range(n)]
    return [(i, rows[5][1] if i % 3 == 0 and i > 20 else v, g) for i, v, g in rows]


NAN, INF = float("nan"), float("inf")
ODD = [
    (3, None, 1), (4, [1.0] * 15 + [None], 1), (5, [NAN] * 16, 2), (6, [INF] + [0.0] * 15, 2), (None, [0.5] * 16, 9), (7, [0.25] * 16, None),
    (7, [0.25] * 16, 3), (8, [-0.25] * 16, None), (1_000, [1.0] * 8, 5), (1_001, [], 5),
]


@pytest.mark.parametrize("rows", [drawn(400), drawn(9), ODD, ODD + drawn(90, seed=4), [], [(1, None, 2)], [(1, [], None), (2, [], 4)]])
def test_codes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("x"), "label_key": F.lit(0), "_n": F.lit(1)})
    got = vector_codes.compress(df.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 1.0]) * rng.randrange(1 << 20) for _ in range(8)], 1) for i in range(60)]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    far = spark.createDataFrame([(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)], SCHEMA)
    assert [(r.error, r.label_error) for r in vector_codes.compress(far, entries=1, rounds=0).orderBy("vec_id").collect()] == [(0, None), (None, None)]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))


@pytest.mark.parametrize("n,width,scale", [(1, 3, 9), (30, 2, 2), (700, 3, 5), (3_000, 8, 700), (600, 1, 10_000), (200, 0, 1)])
def test_walk_equals_brute_force(n, width, scale):
    rng = np.random.default_rng(n)
    points = np.floor(rng.normal(size=(n, width)) * scale).astype(np.int64)
    points[:: 4] = points[0]
    entries = np.concatenate([points[:9], points[:2]])  # with equal ones
    tree = metric_trees.build(points)
    near, sums, counts = metric_trees.walk(tree, entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    back = np.empty(n, np.int64)
    back[tree.order] = near
    assert (back == want).all() and counts.sum() == n
    for e in range(len(entries)):
        assert (sums[e] == points[want == e].sum(0)).all() and counts[e] == (want == e).sum()
    inner = np.flatnonzero(tree.left >= 0)
    assert (tree.sums[inner] == tree.sums[tree.left[inner]] + tree.sums[tree.right[inner]]).all()
    for k in range(len(tree.left)):
        gap = tree.points[tree.first[k] : tree.last[k]] - tree.pivots[k]
        assert np.sqrt((gap**2).sum(1)).max(initial=0) <= tree.radius[k] + 1e-9


def test_far_entries_are_dropped_on_the_way_down():
    rng = np.random.default_rng(8)
    middles = rng.integers(-9_000, 9_000, (16, 8))
    points = (middles[rng.integers(0, 16, 4_000)] + rng.integers(-40, 40, (4_000, 8))).astype(np.int64)
    tree, seen = metric_trees.build(points), []
    real = metric_trees.np.argmin
    metric_trees.np.argmin = lambda a, *k, **o: (seen.append(a.shape[0]), real(a, *k, **o))[1]
    try:
        metric_trees.walk(tree, middles)
    finally:
        metric_trees.np.argmin = real
    assert sum(seen) < 400  # points that were compared one by one
