"""Clusters against plain rounds, and the intervals that cells give."""

import hashlib

import numpy as np
import pytest

from basketlens.llm import centroids

NAN, INF = float("nan"), float("inf")


def plain(rows, count, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    at = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(at))[::-1]
    for _ in range(rounds):
        of = [nearest(v)[0] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, of, strict=True) if j == k] for k in range(len(at))]
        at = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, at, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, j, d in found if j == k) for k in range(len(at))]
    return sorted((str(i), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in found)


def table(n, seed, spread):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, 64)) * spread + rng.integers(0, 4, size=(n, 1))).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    copy = rows[3][1]
    return [*rows, (3, copy), (3, rows[4][1]), (n, copy), (None, copy), (None, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [None, *[0.0] * 63]), (n + 4, [NAN, *[0.0] * 63]), (n + 5, [-INF, *[0.0] * 63]), (n + 6, [0.0] * 64), (n + 7, [-300.5] * 64)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, vector string").repartition(3)


@pytest.mark.parametrize(("n", "spread", "bits"), [(300, 0.2, 7), (300, 1.0, 3), (20, 1.0, 1)])
def test_clusters_equal_plain_rounds(spark, n, spread, bits):
    rows = table(n, 4, spread)
    got = centroids.cluster(frame(spark, rows), bits=bits).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == plain(rows, 40, 5)


def test_equal_vectors_and_empty_tables(spark):
    rows = [(i, [0.5] * 64) for i in range(50)]
    got = centroids.cluster(frame(spark, rows)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 50  # empty clusters stay, ties go to the smaller number
    assert centroids.cluster(frame(spark, rows).limit(0)).count() == 0
    huge = centroids.cluster(frame(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)])).collect()
    assert [r["distance"] for r in huge] == [0, 0]


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(1)
    full = rng.integers(-500, 500, size=(400, 64))
    borders = np.array([[full[:, d].min(), *np.linspace(-300, 300, 15).astype(int), full[:, d].max()] for d in range(64)])
    cells = np.stack([np.searchsorted(borders[d, 1:-1], full[:, d], side="right") for d in range(64)], axis=1)
    at = full[:12] + rng.integers(-40, 40, size=(12, 64))
    bounds = centroids.Bounds(borders, at)
    exact = np.square(full[:, None] - at[None]).sum(axis=2)
    d = np.arange(64)
    for i in range(400):
        assert (bounds.least[d, cells[i]].sum(axis=0) <= exact[i]).all() and (exact[i] <= bounds.most[d, cells[i]].sum(axis=0)).all()
    possible = bounds.possible(cells)
    assert possible[np.arange(400), exact.argmin(axis=1)].all() and possible.sum(axis=1).min() == 1  # the nearest stays possible, and cells alone settle some
    assert (centroids.measured(full, possible, at) == exact.argmin(axis=1)).all()
