"""Snapshots from season states, scans of hot keys by ranges, and as-of by dates, against plain versions."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from stridecast.operators import pit, scan, workload

D = datetime.date


def season(d):
    return d.year + (d.month >= 10)


def plain_snapshot(observed, event, loads):
    """(acwr by scale, spike, days since, week, two weeks) of one observation; loads: day -> load."""
    back = 3 if event == 1 else 2
    days = sorted(d for d in loads if d <= observed and season(observed) - back < season(d) <= season(observed))
    if not days:
        return (None, None, None, 0, None, 0, 0)

    def mean(n):
        w, age = 1 - 1 / n, lambda d: (days[-1] - d).days
        return sum(loads[d] * w ** age(d) for d in days) / sum(w**k for k in range((days[-1] - days[0]).days + 1))

    ratios = [mean(f) / mean(s) if mean(s) >= 1e-3 else None for f, s in workload.SCALES.values()]
    near = lambda n: sum(1 for d in days if (observed - d).days <= n)
    return (*ratios, int(any(r is not None and r > 1.5 for r in ratios)), (observed - days[-1]).days, near(7), near(14))


def test_snapshot(spark):
    r = random.Random(1)
    start = D(2015, 9, 1)
    loads = {k: {start + datetime.timedelta(r.randrange(1900)): float(r.choice([0, 0, 1, 30, 40])) for _ in range(n)} for k, n in (("a", 700), ("b", 40), ("c", 3))}
    loads["a"] |= {D(2017, 9, d): 9.0 for d in (17, 20, 30)} | {D(2017, 10, 1): 50.0}
    asked = [(k, start + datetime.timedelta(r.randrange(-40, 2100)), r.choice([0, 1, None])) for k in "abcd" for _ in range(60)]
    asked += [("a", D(2017, 10, d), e) for d in (1, 2, 8, 14) for e in (0, 1)] + [("a", D(2017, 10, 1), 1)] * 3 + [(None, start, 1), ("a", None, 1)]
    rows = [(k, d, v, 1) for k, days in loads.items() for d, v in days.items()] + [(None, start, 5.0, 1), ("a", None, 5.0, 1)]
    obs = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i int, k string, obs date, ev int")
    got = {x.i: tuple(x)[4:] for x in pit.ratio_snapshot(obs, spark.createDataFrame(rows, "k string, day date, load double, _d int"), "k", "obs", "day", "load", "ev").collect()}
    assert len(got) == len(asked)
    for i, (k, d, e) in enumerate(asked):
        want = plain_snapshot(d, e, loads.get(k, {})) if k and d else (None, None, None, 0, None, 0, 0)
        assert got[i][:3] == tuple(None if w is None else pytest.approx(w, rel=1e-9) for w in want[:3]), (k, d, e)
        assert got[i][3:] == want[3:], (k, d, e)


def test_snapshot_work_does_not_grow_with_history(spark):
    """No operator of the plan makes a row for each pair of an observation and a load."""
    loads = spark.range(2000).select(F.lit("a").alias("k"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit(1.0).alias("load"))
    obs = loads.select("k", F.col("day").alias("obs"), F.lit(1).alias("ev"))
    plan = pit.ratio_snapshot(obs, loads, "k", "obs", "day", "load", "ev")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _events(seed, n):
    """A key with most rows, small ones, a null key; orders with gaps."""
    r = random.Random(seed)
    places = sorted(r.sample(range(10 * n), n))
    return [(r.choice(["hot"] * 8 + ["x", "y", None]), p, r.choice([None, None, None, float(p)]), float(r.randrange(9))) for p in places]


@pytest.mark.parametrize("pieces", [4, 64])
def test_carry_forward_in_ranges(spark, pieces):
    rows = spark.createDataFrame(_events(2, 900) + [("hot", None, 1.5, 0.0), ("none", 3, None, 0.0)], "k string, o long, v double, load double").repartition(5)
    plain = scan.carry_forward(rows, ["k"], "o", F.col("v"), "last")
    cut = scan.carry_forward(rows, ["k"], "o", F.col("v"), "last", most=50, pieces=pieces)
    assert cut.columns == plain.columns
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))
    assert scan.carry_forward(rows.limit(0), ["k"], "o", F.col("v"), "last", most=5).count() == 0


@pytest.mark.parametrize("by_day, windows", [(False, (2, 7, 60)), (True, (5, 100, 4000))])
@pytest.mark.parametrize("pieces", [3, 200])
def test_rolling_in_ranges(spark, by_day, windows, pieces, monkeypatch):
    """Frames that reach over one and over many ranges, ranges of fewer rows than a frame."""
    monkeypatch.setattr(scan.with_earlier_rows, "__defaults__", (False, pieces))
    rows = spark.createDataFrame(_events(3, 700), "k string, o long, v double, load double").repartition(5)
    plain = workload.rolling(rows, ["k"], "o", "load", windows, by_day)
    cut = workload.rolling(rows, ["k"], "o", "load", windows, by_day, most=40)
    assert sorted(cut.columns) == sorted(plain.columns)
    assert sorted(map(repr, cut.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_ranges_are_even(spark):
    """One key in all rows: no range has many more rows than the mean, and rows of one value stay together."""
    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("o"))
    sizes = [r["count"] for r in scan.in_ranges(rows, ["k"], "o", 1000).groupBy("_range").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 3 * 20_000 / len(sizes)
    same = scan.in_ranges(rows.withColumn("o", F.lit(7)), ["k"], "o", 1000)
    assert same.select("_range").distinct().count() == 1


def test_asof_by_dates(spark):
    r = random.Random(5)
    day = lambda: D(2020, 1, 1) + datetime.timedelta(r.randrange(90))
    spine = spark.createDataFrame([(i, r.choice(["a"] * 6 + ["b", "c", None]), r.choice([day(), day(), None]) if i % 9 == 0 else day(), 1) for i in range(400)], "i int, k string, obs date, day int")
    feats = spark.createDataFrame([(r.choice(["a", "b", None]), day(), i, r.choice([None, 1.0])) for i in range(60)], "k string, fday date, n int, v double")
    plain = pit.asof_join(spine, feats, "k", "obs", "fday", ["n", "v"], tie=F.col("n"), prefix="f_")
    dated = pit.asof_join(spine, feats, "k", "obs", "fday", ["n", "v"], tie=F.col("n"), prefix="f_", by_dates=True)
    assert dated.columns == plain.columns
    assert sorted(map(repr, dated.collect())) == sorted(map(repr, plain.collect()))


def test_ranges_are_the_same_wherever_they_are_used(spark):
    """A sketch made anew for each use of the ranges may give other cuts, and then copies and edges that don't fit the rows."""
    rows = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("o"))
    for found in (scan.in_ranges(rows, ["k"], "o", 10), scan.with_earlier_rows(rows, ["k"], "o", 5, 10)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan.lower()
        assert found.filter("_range > 0").count() > 0


@pytest.mark.parametrize("name", ["ratio_snapshot", "ratio_panel", "refreshed_matrix"])
def test_loads_are_summed_once(spark, sf_dir, name):
    """A second sum by entity and day holds all of a task's groups again."""
    from stridecast.plans import catalog

    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"sum\(load#\d+\)", plan) and not re.search(r"sum\(load#\d+\) AS load#", plan)
