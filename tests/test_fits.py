"""Label model, hazards, concordance, quantiles, names, pages: against plain versions."""

import itertools
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridecast.operators import attribution, entities, hazard, metrics, profile, weaklabel
from stridecast.sources import pages as pg
from stridecast.sources import tables as src


def test_label_model_recovers_accuracies(spark):
    """Rules that vote all classes, with planted accuracies and coverage; and rules for one class each."""
    r = np.random.default_rng(0)
    balance, planted, cover = [0.5, 0.3, 0.2], [0.9, 0.8, 0.7, 0.6, 0.85], [0.9, 0.8, 0.9, 0.7, 0.5]
    truth = r.choice(3, 20_000, p=balance)
    votes = np.stack([np.where(r.random(len(truth)) > c, -1, np.where(r.random(len(truth)) < a, truth, (truth + r.integers(1, 3, len(truth))) % 3)) for a, c in zip(planted, cover)], axis=1)
    voted = spark.createDataFrame([(int(t), v.tolist()) for t, v in zip(truth, votes)], "truth int, votes array<int>")
    model = weaklabel.fit_label_model(voted, balance=balance)
    assert [model.accuracy[i] for i in range(5)] == pytest.approx(planted, abs=0.02)
    right = lambda df: df.agg(F.avg((F.col("label") == F.col("truth")).cast("int"))).first()[0]
    assert right(weaklabel.label_model(voted, balance=balance)) > right(weaklabel.majority(voted)) + 0.02
    one = np.stack([np.where(r.random(len(truth)) < np.where(truth == v, a, b), v, -1) for v, a, b in ((0, 0.7, 0.1), (0, 0.5, 0.05), (0, 0.6, 0.2), (1, 0.8, 0.1), (1, 0.6, 0.02), (1, 0.7, 0.1))], axis=1)
    model = weaklabel.fit_label_model(spark.createDataFrame([(v.tolist(),) for v in one], "votes array<int>"), balance=balance)
    assert [model.hit[i, i // 3] for i in range(6)] == pytest.approx([0.7, 0.5, 0.6, 0.8, 0.6, 0.7], abs=0.06)
    none = spark.createDataFrame([([-1, -1],), ([7, -1],)], "votes array<int>")
    assert [(x.probs, x.label) for x in weaklabel.label_model(none).collect()] == [(None, -1)] * 2


def _subjects(spark, n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    t = np.minimum(r.geometric(np.clip(0.06 * np.exp(0.8 * x[:, 0]), 0, 0.9)) - 1, 14)
    e = np.where(t >= 12, 0, r.choice(3, n, p=[0.2, 0.6, 0.2]))
    rows = [(int(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)]
    return spark.createDataFrame(rows + [(None, 1, 0.0, 0.0), (3, None, None, 1.0)], "t int, e int, x double, y double")


def test_hazards(spark):
    rows = _subjects(spark, 3000).repartition(4)
    models = hazard.fit_grid(rows, ["x", "y"], 12, 2, (1e-4, 1e-2, 10.0))
    for m in models:
        values = [v for v, _ in m.steps]
        assert values == sorted(values) and len(values) > 1
    assert models[0].weights[0][0] == pytest.approx(0.8, abs=0.15) and abs(models[0].weights[0][1]) < 0.1
    assert abs(models[2].weights[0][0]) < 0.1 < models[1].weights[0][0] < models[0].weights[0][0]
    alone = hazard.fit_hazards(rows, ["x", "y"], 12, 2, 1e-2)
    assert np.array(alone.weights) == pytest.approx(np.array(models[1].weights), abs=1e-6)
    # the gradient at the fit is 0: moving any weight lowers the plain likelihood
    m, data = models[1], rows.filter("t is not null").na.fill({"x": m.scaler["x"][0]} if (m := models[1]) else {}).collect()
    z = np.array([[(r.x - m.scaler["x"][0]) / m.scaler["x"][1], (r.y - m.scaler["y"][0]) / m.scaler["y"][1]] for r in data])
    last, cause = np.array([min(r.t, 11) for r in data]), np.array([r.e if r.e in (1, 2) and r.t < 12 else 0 for r in data])

    def likelihood(w):
        total = 0.0
        for c in (1, 2):
            for b in range(12):
                hit = (cause == c) & (last == b)
                if hit.any():
                    total += (z[hit] @ w[c - 1]).sum() - hit.sum() * np.log(np.exp(z[last >= b] @ w[c - 1]).sum())
        return total - 1e-2 * len(z) / 2 * (np.array(w) ** 2).sum()

    best = np.array(m.weights)
    assert likelihood(best) == pytest.approx(m.steps[-1][0], rel=1e-9)
    for c, k, d in itertools.product((0, 1), (0, 1), (-1e-3, 1e-3)):
        moved = best.copy()
        moved[c, k] += d
        assert likelihood(moved) < likelihood(best)
    for r in m.score(rows.limit(20)).collect():
        flat = [p for row in r.pmf for p in row]
        assert len(r.pmf) == 2 and len(r.pmf[0]) == 12 and min(flat) >= 0 and sum(flat) < 1


def test_hazard_sums_do_not_grow_with_bins(spark):
    data = spark.createDataFrame([([1.0, 2.0], t % 7) for t in range(50)], "x array<double>, last int")
    few, many = (hazard._at_risk(data, np.zeros((1, 1, 2)), b) for b in (7, 700))
    assert few[0, 0, 0].tolist() == [50, 50, 100, 50, 100, 200] == many[0, 0, 0].tolist()
    assert not many[0, 0, 7:].any()


def test_no_events(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (2, 0, 1.0)], "t int, e int, x double")
    m = hazard.fit_hazards(rows, ["x"], 4, 2)
    assert m.weights == [[0.0], [0.0]] and all(p == 0 for row in m.score(rows).first().pmf for p in row)
    assert hazard.fit_hazards(rows.limit(0), ["x"], 4, 2).weights == [[0.0], [0.0]]
    best, tried, _ = hazard.sweep(rows, rows, ["x"], [0.1, 0.2], 4)
    assert best == 0.1 and [t["c_index"] for t in tried] == [0.5, 0.5]


@given(st.lists(st.tuples(st.integers(-3, 40), st.integers(0, 5), st.integers(0, 3), st.integers(0, 3)), max_size=40))
@settings(max_examples=300, deadline=None)
def test_earlier_and_lower(rows):
    t, risk, members, asking = (np.array([r[i] for r in rows], float if i == 1 else np.int64) for i in range(4))
    want = sum(a[3] * b[2] * ((b[1] < a[1]) + (b[1] == a[1]) / 2) for a in rows for b in rows if b[0] > a[0])
    assert metrics.earlier_and_lower(t, risk, members, asking) == want


def test_concordance(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.randrange(9), r.randrange(3), [[round(r.random(), 1) / 9 for _ in range(9)]]) for _ in range(300)]
    m = max(t for t, _, _ in rows)
    risk = [round(sum(p[0][: m + 1]), 12) for _, _, p in rows]
    pairs = [(risk[i] > risk[j]) + (risk[i] == risk[j]) / 2 for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] == 1 and b[0] > a[0]]
    df = spark.createDataFrame(rows, "t int, e int, pmf array<array<double>>")
    got = metrics.concordance(df).first()
    monkeypatch.setattr(metrics, "FEW", 0)  # the same in tasks
    assert tuple(metrics.concordance(df).first()) == tuple(got)
    assert (got.n_pairs, got.concordant) == (len(pairs), pytest.approx(sum(pairs)))
    assert tuple(metrics.concordance(df.limit(0)).first()) == (0, 0.0, 0.5)
    report = metrics.evaluation_report(df).first()
    assert report.c_index == round(got.c_index, 4) and report.nll == round(metrics.losses(df).first().nll, 4)
    assert report.ibs == round(metrics.integrated(metrics.brier(df)).first().ibs, 4)


def test_bounded_attributions(spark):
    """Against exact Shapley values of a score with interactions: rows that vary little leave early, and errors hold."""
    r = np.random.default_rng(2)
    back = r.normal(size=(10, 3))
    rows = np.vstack([r.normal(size=(12, 3)) * 3, back.mean(axis=0)[None, :] + np.zeros((3, 3))])
    as_df = lambda m: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(m)], "id int, a double, b double, c double")
    value = lambda a, b, c: a * b + 0.5 * c + 0.1 * a * b * c
    score = lambda df: df.withColumn("score", value(F.col("a"), F.col("b"), F.col("c")))

    def exact(x):
        phi = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for z in back:
                now = z.copy()
                for k in order:
                    before = value(*now)
                    now[k] = x[k]
                    phi[k] += value(*now) - before
        return phi / 60

    got = attribution.bounded_shapley(as_df(rows), as_df(back), "id", ["a", "b", "c"], score, 0.4, rounds=5).collect()
    assert len(got) == 45 and len({x.n_pairs for x in got}) > 1 and max(x.n_pairs for x in got) <= 310
    for x in got:
        want = exact(rows[x.id])["abc".index(x.feature)]
        assert abs(x.phi - want) <= 3 * x.error + 1e-9 and (x.error <= 0.4 or x.n_pairs == 310)
    with pytest.raises(ValueError):
        attribution.bounded_shapley(as_df(rows), as_df(back).limit(0), "id", ["a"], score, 0.1)


def test_quantiles_of_many_values(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=40_000), np.zeros(20_000)])
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v)) for v in range(7)] + [("c", None)], "feature string, value double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {(q.feature, q.i): q.value for q in profile.quantiles(rows, shares).collect()}
    assert [got["a", i] for i in range(7)] == pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12)
    assert [got["b", i] for i in range(7)] == pytest.approx(np.quantile(np.arange(7), shares).tolist())


def test_names(spark):
    r = random.Random(4)
    part = lambda: "".join(r.choice("abc") for _ in range(r.choice([1, 1, 2, 3, 5])))
    listed = [(i, f"{part()} {part()}", r.randrange(9)) for i in range(60)] + [(100, "x" * 70 + " long ab", 1), (101, None, 0), (102, "", 0)]
    asked = [part() for _ in range(40)] + [f"{part()} {part()}" for _ in range(80)] + ["LONG AB", "x" * 70 + " long abc", None, "", "Zed"]
    key = lambda s: s.lower()

    def plain(name):
        n, known = key(name), [(rank, i, key(f)) for i, f, rank in listed if f]
        for tier, ok in ((1, lambda f: f == n), (2, lambda f: n in f or f in n)):
            hits = sorted(k[:2] for k in known if n and ok(k[2]))
            if hits:
                return hits[0][1], tier
        hits = [k for k in known if n and n.split()[-1] in k[2] and k[2][0] == n[0]]
        return (hits[0][1], 3) if len(hits) == 1 else (None, 0)

    got = entities.resolve_names(spark.createDataFrame([(n,) for n in asked], "name string"), spark.createDataFrame(listed, "id int, full string, rank int"), "name", "id", "full", "rank").collect()
    assert {x.name: (x.id, x.tier) for x in got} == {n: plain(n) for n in set(asked) if n is not None}


def test_inner_html(spark):
    many = '<div id="meta">' + "<p>x</p><div><div><b>y</b></div></div>" * 5000 + "<p>6-7, 240lb</p><p>Position: " + "z" * 50_000 + " ▪ q</p></div><p>5-1, 100lb</p>"
    rows = [("many", many), ("null", None), ("none", "no"), ("open", '<div id="meta"><p>6-1, 200lb</p>'), ("mixed", '<DIV class="x" id="meta">a<div>b<DIV>c</DIV></div>d<divan></DIV>e')]
    df = spark.createDataFrame(rows, "url string, html string")
    inner = {r.url: r.x for r in df.select("url", pg.inner_html(F.col("html"), pg.META).alias("x")).collect()}
    assert inner["mixed"] == "a<div>b<DIV>c</DIV></div>d<divan>" and inner["none"] == inner["null"] == ""
    found = {r.player_url: r for r in pg.entity_bio(df).collect()}
    assert found["many"].height_inches == 79 and found["many"].position == "z" * 50_000 and found["open"].weight_lbs == 200


def test_changed_pages(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()

    def put(name, content, age):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (now - age, now - age))

    now = time.time() - 1000
    put("a.html", "<p>é</p>".encode(), 100)
    put("b.html", b'<meta charset="iso-8859-1"><p>\xe9</p>', 90)
    put("c.html", b"<p>\xff</p>", 80)
    first = src.scan_pages(spark, str(folder))
    assert {r.key: r.html[-6:] for r in first.collect()} == {"a": ">é</p>", "b": ">é</p>", "c": ">�</p>"}
    seen = spark.createDataFrame(first.select("key", "modified", "sha256").collect(), "key string, modified timestamp, sha256 string")
    assert src.changed_pages(spark, str(folder), seen).count() == 0
    put("a.html", b"new", 10)  # changed
    put("b.html", b'<meta charset="iso-8859-1"><p>\xe9</p>', 5)  # written again with the same bytes
    put("late.html", b"late", 95)  # unknown, but older than the last one seen
    put("fresh.html", b"fresh", 1)
    assert {(r.key, r.html) for r in src.changed_pages(spark, str(folder), seen).collect()} == {("a", "new"), ("late", "late"), ("fresh", "fresh")}
    assert src.changed_pages(spark, str(folder), seen.limit(0)).count() == 5


def test_attributions_of_a_small_file_are_many_tasks(spark):
    """Rows are dealt out before they are multiplied by permutations, in each round; the sums aren't shuffled again."""
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)], "id int, a double, b double").coalesce(1)
    seen = []

    def score(df):
        out = df.withColumn("score", F.col("a") * F.col("b"))
        seen.append((df.rdd.getNumPartitions(), out.groupBy("id", "pair").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return out

    got = attribution.bounded_shapley(rows, rows.orderBy("id").limit(4), "id", ["a", "b"], score, 1e-12, 2).collect()
    assert len(got) == 400 and len(seen) == 2
    assert seen == [(4, 1)] * 2
