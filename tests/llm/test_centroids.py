"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stridecast.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, named int, label int"


def plain(rows, k=8, rounds=10):
    """vec_id, cluster, distance, cluster_inertia, inertia, sum of the centroid, of rows without repeated or null ids."""
    kept = {i: [math.floor(1024 * float(x)) for x in v] for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)}
    cents = [kept[i] for i in sorted(kept, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = defaultdict(list)
        for v in kept.values():
            groups[nearest(v)[1]].append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(cents)]
    found = {i: nearest(v) for i, v in kept.items()}
    spread = defaultdict(int)
    for d, n in found.values():
        spread[n] += d
    return sorted((i, n, d, spread[n], sum(spread.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, (d, n) in found.items())


def vectors(seed, n):
    r = random.Random(seed)
    means = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    out = [(i, [float(np.float32(m + r.gauss(0, 0.3))) for m in r.choice(means)]) for i in range(n)]
    return out + [(n + i, out[i][1]) for i in range(min(n, 9))]


def as_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, None) for i, v in rows], SCHEMA)


def test_equals_plain_version(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(1, 120) + [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [nan] * 64), (905, [inf] + [0.0] * 63), (906, [0.0] * 64), (907, [-0.0] * 64), (908, [1.0] * 65)]
    got = centroids.centroid_clusters(as_table(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_few_rows_ties_and_none(spark):
    for rows in (vectors(2, 1), vectors(3, 5), [(i, [0.5] * 64) for i in range(20)], [(i, [float(i % 2)] * 64) for i in range(20)]):
        got = centroids.centroid_clusters(as_table(spark, rows))
        assert sorted(map(tuple, got.collect())) == plain(rows)
    assert centroids.centroid_clusters(as_table(spark, [(1, None)])).count() == 0


def test_repeats_nulls_and_very_large(spark):
    """Rows of one id and without an id are rows of their own; integers whose distances a long can't hold take no part."""
    base = vectors(4, 40)
    rows = base + [base[0], base[0], (None, base[1][1]), (5000, [200_000.0] * 64)]
    got = centroids.centroid_clusters(as_table(spark, rows)).collect()
    assert len(got) == len(rows) - 1
    assert sum(r.distance for r in got) == got[0].inertia
    assert len({r.cluster for r in got if r.vec_id == 0}) == 1
    assert sum(r.vec_id is None for r in got) == 1


@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 12), st.sampled_from([1, 3, 50, 10**5, 2**27 - 1]))
@settings(max_examples=150, deadline=None)
def test_search_is_exact(seed, k, dims, most):
    r = np.random.default_rng(seed)
    x, c = r.integers(-most, most + 1, (60, dims)), r.integers(-most, most + 1, (k, dims))
    c[r.integers(0, k)] = c[0]
    x[:k] = c[: len(x)][: len(x[:k])]
    number, distance, _ = centroids.Codebook(c).assign(x)
    every = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert distance.tolist() == every.min(axis=1).tolist()
    assert number.tolist() == every.argmin(axis=1).tolist()


def test_bounds_reject_most():
    r = np.random.default_rng(5)
    level = r.uniform(-500, 500, (2000, 1))
    x = (level + r.normal(0, 20, (2000, 64))).astype(int)
    book = centroids.Codebook(x[:100])
    assert book.assign(x)[2] < 0.3 * 100 * len(x)
