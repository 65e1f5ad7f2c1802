"""Codes and clusters of vectors against plain versions, on awkward vectors."""

import hashlib
import random

import numpy as np
import pytest

from docloom.llm import drake, vector_codes
from docloom.llm.vectors import squared

WIDTH = 64


@pytest.fixture(scope="module")
def vectors():
    """(vec_id, embedding, label): groups, ties, copies, repeated and null ids, and rows that are to go."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(WIDTH)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 6]], rng.choice([None, 0, 1])) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(200)]  # copies
    rows += [(2000 + i, [float(i % 2)] * WIDTH, 7) for i in range(40)]  # equally far from much
    rows += [(None, rows[5][1], 1), (None, centres[0], None), (3, rows[9][1], 0), (3, rows[3][1], 0)]
    rows += [(5000, None, 0), (5001, [0.5] * 63, 0), (5002, [float("nan")] + [0.0] * 63, 0), (5003, [float("inf")] + [0.0] * 63, 0), (5004, [None] + [0.0] * 63, 0), (5005, [], 0)]
    rng.shuffle(rows)
    return rows


def integers(vectors, scale):
    ok = lambda v: v is not None and len(v) == WIDTH and all(x is not None and np.isfinite(x) for x in v)
    return [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], label) for i, v, label in vectors if ok(v)]


def frame(spark, vectors):
    rows = [(i, v, label, "x", "y", 1) for i, v, label in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, code string, cluster int").repartition(3)


def plain_means(x, of, entries):
    return [[sum(r[j] for r in own) // len(own) for j in range(len(e))] if (own := [r for r, c in zip(x, of, strict=True) if c == k]) else e for k, e in enumerate(entries)]


def plain_nearest(x, entries):
    best = [min((sum((a - b) ** 2 for a, b in zip(r, e, strict=True)), k) for k, e in enumerate(entries)) for r in x]
    return [k for _, k in best], [d for d, _ in best]


@pytest.mark.parametrize("entries", [1, 16, 37])
def test_codes(spark, vectors, entries):
    p = vector_codes.Codes(entries=entries, rounds=3)
    kept = integers(vectors, p.scale)
    first = [v for _, v in sorted((i, v) for i, v, _ in kept if i is not None)[:entries]]
    codes, error, books = [""] * len(kept), [0] * len(kept), []
    for k in range(8):
        x, book = [v[8 * k : 8 * k + 8] for _, v, _ in kept], [v[8 * k : 8 * k + 8] for v in first]
        for _ in range(3):
            book = plain_means(x, plain_nearest(x, book)[0], book)
        of, d = plain_nearest(x, book)
        codes, error = [c + f"{e:02x}" for c, e in zip(codes, of, strict=True)], [a + b for a, b in zip(error, d, strict=True)]
        books += [v for e in book for v in e]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    sums: dict = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    want = sorted((str(i), c, e, sums[label], digest) for (i, _, label), c, e in zip(kept, codes, error, strict=True))
    got = vector_codes.with_label_errors(vector_codes.compress(frame(spark, vectors), p))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("k", [1, 3, 40])
def test_clusters(spark, vectors, k):
    p = drake.Clusters(k=k)
    kept = integers(vectors, p.scale)
    x = [v for _, v, _ in kept]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v, _ in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    for _ in range(p.rounds):
        centroids = plain_means(x, plain_nearest(x, centroids)[0], centroids)
    of, d = plain_nearest(x, centroids)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = [sum(e for e, b in zip(d, of, strict=True) if b == c) for c in range(k)]
    want = sorted((str(i), c, e, own[c], sum(d), digest[c]) for (i, _, _), c, e in zip(kept, of, d, strict=True))
    got = drake.cluster(frame(spark, vectors), p).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == want
    if k == 40:  # bounds spare most vectors all distances
        assert sum(r.looked == 1 for r in got) > len(got) / 2


def test_without_vectors(spark, vectors):
    for rows in ([], [r for r in vectors if r[1] is None or len(r[1]) != WIDTH], [(None, [1.0] * WIDTH, 0)]):
        given = frame(spark, rows)
        assert vector_codes.with_label_errors(vector_codes.compress(given)).count() == 0
        assert drake.cluster(given).count() == 0
    with pytest.raises(Exception, match="beyond"):
        drake.cluster(frame(spark, [(1, [1e30] * WIDTH, 0)])).count()


def test_tree_visits_less_and_finds_all(monkeypatch):
    rng = np.random.default_rng(3)
    for size, spread in ((1, 5), (2, 5), (16, 2), (200, 1000), (64, 1)):
        entries = rng.integers(-spread, spread + 1, (size, 8)) + 50 * spread * rng.integers(0, 4, (size, 1))
        points = np.concatenate((entries, rng.integers(-spread, 200 * spread, (300, 8))))
        seen = []
        monkeypatch.setattr(vector_codes, "squared", lambda x, y: seen.append(len(x)) or squared(x, y))  # noqa: B023
        index, d = vector_codes.nearest(vector_codes.build(entries, 2), entries, points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        if size == 200:
            assert sum(seen) < len(points) * size / 2


def test_bounds_hold():
    """After moves and reassignments bounds are still bounds, and the first id is the nearest centroid."""
    rng = np.random.default_rng(4)
    x, centroids = rng.integers(-50, 50, (500, 16)), rng.integers(-50, 50, (24, 16))
    b, n = drake.scan(x, centroids, 6), 6
    for step in (1, 3, 0, 20, 1, 1):
        new = centroids + rng.integers(-step, step + 1, centroids.shape)
        n = max(3, n - 1)
        b = drake.reassign(x, new, drake.moved(b, drake.above(squared(new, centroids)), n))
        centroids = new
        every = np.sqrt(((x[:, None] - centroids[None]) ** 2).sum(axis=2))
        own = np.take_along_axis(every, b.ids, axis=1)
        assert (b.ids[:, 0] == every.argmin(axis=1)).all()
        assert (b.upper >= own[:, 0] * (1 - 1e-9)).all() and (b.lower[:, 1:] <= own[:, 1:] + 1e-9).all()
        others = every.copy()
        np.put_along_axis(others, b.ids, np.inf, axis=1)
        assert (b.rest <= others.min(axis=1) + 1e-9).all()
    assert (b.looked == 1).any() and (b.looked > 1).any()
