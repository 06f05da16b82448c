"""Clustering in whole numbers against a plain version."""

import hashlib
import math
import random

import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import centroids  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def plain(rows, dims, k, rounds):
    import numpy as np

    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    at = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    place = lambda: [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds):
        got, new = place(), list(at)
        for j in range(len(at)):
            own = [v for (_, v), (_, c) in zip(kept, got, strict=True) if c == j]
            if own:
                new[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
        at = new
    got = place() if kept else []
    total = sum(d for d, _ in got)
    return sorted(((i is not None, i or 0), c, d, sum(x for x, y in got if y == c), total, hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, got, strict=True))


def result(df):
    return sorted(((r[0] is not None, r[0] or 0), *r[1:6]) for r in df.collect())


def vectors(dims, n=300, seed=2):
    r = random.Random(seed)
    hubs = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(k, [x + r.gauss(0, 0.2) for x in r.choice(hubs)], "x", 1) for k in range(n)]
    bad = [float("nan"), float("inf"), None]
    rows += [(900 + j, [*hubs[0][:-1], b], None, None) for j, b in enumerate(bad)] + [(910, None, "y", 1), (911, hubs[1][:-1], "y", 1), (912, [], "y", 1), (None, hubs[2], "z", 0)]
    return rows + [rows[4], rows[4], (5, hubs[3], "y", 1), (920, [0.0] * dims, "y", 1)] + [(2000 + j, hubs[5], "hot", 1) for j in range(150)]


@pytest.mark.parametrize(("dims", "k"), [(64, 8), (16, 3), (4, 5)])
def test_cluster(spark, dims, k):
    rows = vectors(dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(centroids.cluster(df, dims=dims, k=k, rounds=4)) == plain(rows, dims, k, 4)


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(k, [float(k % 2)] * 8, None, None) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = centroids.cluster(df, dims=8, rounds=3, carry=("vec_id", "cluster"))
    assert got.columns[:4] == ["vec_id", "cluster", "_cluster", "distance"]
    assert result(got.drop("cluster")) == plain(rows, 8, 8, 3)


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(df).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 8, None, None)], SCHEMA), dims=8)


def test_bounds_hold_and_screen():
    import numpy as np

    r = np.random.default_rng(1)
    v = r.integers(-1000, 1000, (500, 64))
    v[250:] = v[250:] // 100 + 2000
    c = np.concatenate([v[:4], v[250:254]])
    low = centroids.bounds(centroids.compressed(v), centroids.compressed(c))
    exact = np.square(v[:, None] - c[None]).sum(axis=2)
    assert (low <= 8 * exact).all()
    cluster, distance, needed = centroids.nearest(v, centroids.compressed(v), c.tolist())
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert needed < 0.6 * exact.size  # of two far groups, one is screened
