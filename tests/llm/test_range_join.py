"""The exact range join against all pairs."""

import math

import numpy as np
import pytest

from stridecast.llm import range_join
from stridecast.llm.range_join import Metric, compare, families, similar_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node long, size int, cell int"


def plain(rows, similarity=0.95):
    """vec_id -> (n_links, component_id, kept), for distinct ids."""
    valid = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, least = sorted(valid), {i: i for i, _ in rows}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in valid.items()}
    links = {i: [j for j in ids if j != i and len(valid[i]) == len(valid[j]) and unit[i] @ unit[j] >= similarity] for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            m = min([least[i], *(least[j] for j in links[i])])
            changed |= m < least[i]
            least[i] = m
    return sorted((i, len(links.get(i, [])), least[i], least[i] == i) for i, _ in rows)


def as_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(6)


def check(spark, rows, **settings):
    got = similar_vectors(as_table(spark, rows), **settings)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == plain(rows, settings.get("similarity", 0.95))


def groups(seed, dims, sizes, spread):
    r = np.random.default_rng(seed)
    out = []
    for n in sizes:
        base = r.normal(size=dims)
        out += [(base + spread * r.uniform(0, 1) * r.normal(size=dims)) * r.uniform(0.1, 9) for _ in range(n)]
    ids = r.permutation(3 * len(out))[: len(out)]
    return [(int(i), v.tolist()) for i, v in zip(ids, out)]


@pytest.mark.parametrize("dims, spread, block", [(3, 0.5, 16), (8, 0.4, 16), (64, 0.35, 32), (2, 0.3, 8)])
def test_all_links(spark, dims, spread, block):
    """Chains, dense and loose groups and singles, in many cells, rings and blocks."""
    rows = groups(dims, dims, [90, 40, 30, *[1] * 60, *[3] * 15], spread)
    check(spark, rows, block=block, sample=200)


def test_other_ranges(spark):
    check(spark, groups(9, 4, [60, 50, *[1] * 60], 0.4), similarity=0.8, block=16, sample=100)
    check(spark, groups(9, 4, [60, 50, *[1] * 60], 0.02), similarity=0.9995, block=16, sample=100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = groups(1, 5, [20, 1, 1, 4], 0.2)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 5), (1003, [nan] * 5), (1004, [1.0, inf, 0, 0, 0]), (1005, [1.0, None, 0, 0, 0]), (1006, [1.0]), (1007, [2.0]), (1008, [-1.0]), (1009, [1e200] * 5), (1010, [2e200] * 5), (1011, [1e-200] * 5), (1012, [1.0] * 5)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    check(spark, rows, block=8, sample=40)
    check(spark, [(1, [1.0, 0.0])])
    assert similar_vectors(as_table(spark, [(1, None)]).limit(0)).count() == 0
    assert sorted(map(tuple, similar_vectors(as_table(spark, [(2, None), (3, [0.0])])).collect())) == [(2, 0, 2, True), (3, 0, 3, True)]


def test_repeated_and_missing_ids(spark):
    """The largest vector of an id counts; a row without an id has no result."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (None, [1.0, 0.0]), (3, None)]
    assert sorted(map(tuple, similar_vectors(as_table(spark, rows)).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_dense_group_makes_no_pairs(spark):
    """A group of near copies is decided by its rings: no row of it is dealt to a comparison within its cell."""
    r = np.random.default_rng(3)
    base = r.normal(size=32)
    near = [base + 0.01 * r.normal(size=32) for _ in range(600)]
    rows = [(i, v.tolist()) for i, v in enumerate(near)] + [(600 + i, r.normal(size=32).tolist()) for i in range(200)]
    check(spark, rows, block=64, sample=400)
    metric = Metric(0.95)
    pivot = range_join.choose_pivots(np.array(near), 4, metric)
    assert len(pivot) == 1
    cells = range_join.Cells(metric, {32: pivot})
    home, ring = cells.homes(range_join.unit(np.array(near)))
    assert 2 * ring.max() + 2 <= metric.sure and not home.any()


def test_rings_are_bounds():
    metric, r = Metric(0.95), np.random.default_rng(4)
    pivot = range_join.unit(r.normal(size=(1, 4)))
    x = range_join.unit(pivot + r.normal(size=(800, 4)) * r.uniform(0, 0.5, (800, 1)))
    rings = metric.ring((x @ pivot.T)[:, 0])
    linked, total, gap = x @ x.T >= 0.95, rings[:, None] + rings[None, :] + 2, np.abs(rings[:, None] - rings[None, :])
    assert linked[total <= metric.sure].all() and not linked[gap >= metric.apart].any()
    assert (total <= metric.sure).any() and (gap >= metric.apart).any()


def test_threshold_in_double_precision():
    """Cosines within a single-precision error of the threshold are decided in double precision."""
    metric, angle = Metric(0.95), math.acos(0.95)
    turned = [angle + d for d in (-1e-9, 1e-9, -1e-13 - 1e-9, 1e-7, -1e-7)]
    x, y = np.array([[1.0, 0.0]]), np.array([[math.cos(a), math.sin(a)] for a in turned])
    far = np.full(1, 300), np.full(5, 300)
    links, theirs, labels = compare(x, y, *far, np.ones(1, np.int64), np.ones(5, np.int64), metric, False)
    assert theirs.tolist() == [1, 0, 1, 0, 1] and links.tolist() == [3]
    assert (labels[1:] == labels[0]).tolist() == [True, False, True, False, True]


def test_families_hold_blocks():
    of, spans = families({3: 5, 4: 4, 7: 2, 9: 25, 12: 1, 13: 10}, 10)
    assert spans == [(3, 4, 1), (7, 7, 1), (9, 9, 3), (12, 12, 1), (13, 13, 1)]
    assert of[9] == (2, 3) and of[4] == (0, 1) and of[13] == (4, 1)
