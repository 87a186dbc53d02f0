import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridecast.functions import curves
from stridecast.functions import scalars as sc
from stridecast.operators import attribution, cohort, entities, filters, metrics, pit, prep, profile, weaklabel, workload
from stridecast.sources import pages as pg
from stridecast.sources import tables as src

D = dt.date


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_scalars(spark):
    df = spark.createDataFrame([("35:42", "6-7", "220 lbs", "Center-Forward"), ("DNP", "x", "", None), (None, None, None, "guard"), ("12.5", "5-11", "180", " Forward")], "mp string, h string, w string, p string")
    assert [round(x, 3) for x in values(df, sc.minutes(F.col("mp")))] == [35.7, 0, 0, 12.5]
    assert values(df, sc.height_inches(F.col("h"))) == [79, 78, 78, 71]
    assert values(df, sc.weight_lbs(F.col("w"))) == [220, 220, 220, 180]
    assert values(df, sc.position_code(F.col("p"))) == [2, 1, 0, 1]
    names = spark.createDataFrame([("• Al Bo (b)",), ("Alexander Bo (x) / Al Bo",), ("A/B",), (" C. Day ",)], "n string")
    assert values(names, sc.clean_name(F.col("n"))) == ["Al Bo", "Al Bo", "A", "C. Day"]
    texts = spark.createDataFrame([("on May 3, 2021 and June 4, 2022",), ("Smarch 1, 2020",), ("February 31, 2020",), (None,)], "t string")
    assert values(texts, sc.first_date(F.col("t"))) == [D(2021, 5, 3), None, None, None]
    days = spark.createDataFrame([(D(2023, 10, 1),), (D(2024, 6, 15),)], "d date")
    assert values(days, sc.season_label(sc.season_year(F.col("d")))) == ["2023-24", "2023-24"]
    assert values(days, sc.days_into_season(F.col("d"))) == [0, 258]
    bins = spark.createDataFrame([(-5,), (0,), (30,), (31,), (1825,), (9999,)], "d int")
    assert values(bins, sc.time_bin(F.col("d"))) == [0, 0, 0, 1, 59, 59]


def test_ewma_against_pandas(spark):
    days = [0, 1, 2, 5, 9, 10, 30, 31, 90, 400, 2000, 5000]
    loads = [3.0, 0.0, 7.0, 1.0, 2.0, 2.0, 9.0, 4.0, 1.0, 6.0, 5.0, 8.0]
    start = D(2000, 1, 1)
    df = spark.createDataFrame([(1, start + dt.timedelta(d), x) for d, x in zip(days, loads)], "k int, day date, load double")
    got = workload.load_ratios(df, ["k"], "day", "load").orderBy("day").toPandas()
    full = pd.Series(0.0, range(days[-1] + 1))
    full[days] = loads
    for s, pair in workload.SCALES.items():
        means = [full.ewm(span=2 * d - 1, adjust=True).mean()[days].to_numpy() for d in pair]
        assert got[f"ewma_acute_{s}"].to_numpy() == pytest.approx(means[0], rel=1e-9, abs=1e-200)
        assert got[f"ewma_chronic_{s}"].to_numpy() == pytest.approx(means[1], rel=1e-9, abs=1e-200)
        floor = means[1] < workload.FLOOR
        assert (got[f"acwr_{s}"].isna() == floor).all()
    assert values(workload.add_spikes(workload.load_ratios(df, ["k"], "day", "load")), "spike_any").count(None) == 0


def test_load_ratios_sort_once(spark):
    """All windows of a calendar's means share one shuffle and one sort, so that a task holds its rows once."""
    df = spark.createDataFrame([(1, D(1950, 1, 1), 2.0), (1, D(2020, 1, 5), 3.0), (1, D(2020, 1, 6), 3.0)], "k int, day date, load double")
    out = workload.load_ratios(df, ["k"], "day", "load")
    plan = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString()
    assert plan[0].count("Window ") > 2 and plan[1].count("Sort [") == 1 and plan[1].count("Exchange ") == 1
    got = out.orderBy("day").collect()
    assert got[0].ewma_acute_7_28 == pytest.approx(2.0) and got[2].ewma_acute_3_21 == pytest.approx((3.0 * 2 / 3 + 3.0) / 3)


def test_gap_fill_and_rolling(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), 2.0, "a"), (1, D(2020, 1, 4), 3.0, "b"), (2, D(2020, 1, 1), 0.0, "c")], "k int, day date, load double, team string")
    rows = [tuple(r) for r in workload.fill_gaps(df, "k", "day", "load").orderBy("k", "day").select("k", "load", "team", "_gap_fill").collect()]
    assert rows == [(1, 2.0, "a", False), (1, 0.0, "a", True), (1, 0.0, "a", True), (1, 3.0, "b", False), (2, 0.0, "c", False)]
    assert values(workload.rolling(df, ["k"], "day", "load", (2,)).orderBy("k", "day"), "load_sum_2") == [2, 5, 0]
    assert values(workload.rolling(df, ["k"], "day", "load", (2,), by_day=True).orderBy("k", "day"), "load_sum_2") == [2, 3, 0]


def test_asof_keeps_the_row(spark):
    spine = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 1)), (2, D(2020, 1, 1)), (None, D(2020, 1, 9))], "k int, obs date")
    feats = spark.createDataFrame([(1, D(2020, 1, 2), 1, 7.0), (1, D(2020, 1, 5), 2, None), (1, D(2020, 1, 5), 1, 9.0), (1, D(2020, 1, 6), 3, 4.0)], "k int, day date, n int, v double")
    rows = {(r.k, r.obs): (r.n, r.v) for r in pit.asof_join(spine, feats, "k", "obs", "day", ["n", "v"], tie=F.col("n")).collect()}
    assert rows == {(1, D(2020, 1, 5)): (2, None), (1, D(2020, 1, 1)): (None, None), (2, D(2020, 1, 1)): (None, None), (None, D(2020, 1, 9)): (None, None)}


def test_spine_is_inclusive_and_skips_late_debuts(spark):
    people = spark.createDataFrame([(1, D(2020, 1, 1)), (2, D(2020, 1, 1)), (3, D(2021, 1, 1))], "k int, debut date")
    events = spark.createDataFrame([(1, D(2020, 1, 31)), (1, D(2020, 2, 20)), (3, D(2020, 5, 1))], "k int, day date")
    rows = sorted(tuple(r) for r in pit.observation_spine(people, events, "k", "debut", "day", "2020-02-01").collect())
    assert rows == [(1, D(2020, 1, 1), 1, 30), (1, D(2020, 1, 31), 1, 0), (2, D(2020, 1, 1), 0, 31), (2, D(2020, 1, 31), 0, 1)]


def test_entities(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 5, None), (1, 3, 6, "z")], "k int, o int, a int, b string")
    assert tuple(entities.first_values(df, "k", F.col("o")).select("o", "a", "b").first()) == (1, 5, "x")
    assert tuple(entities.first_row(df, "k", F.col("o")).select("o", "a", "b").first()) == (1, None, "x")
    known = spark.createDataFrame([(1, "Ann Lee", 1), (2, "Bo Kim", 2), (3, "Bob Kimball", 3), (4, "Cy Poe", 4)], "id int, full string, r int")
    names = spark.createDataFrame([("ann lee",), ("Kim",), ("C. Poe",), ("Zed",), ("",), (None,)], "name string")
    got = {r.name: (r.id, r.tier) for r in entities.resolve_names(names, known, "name", "id", "full", "r").collect()}
    assert got == {"ann lee": (1, 1), "Kim": (2, 2), "C. Poe": (4, 3), "Zed": (None, 0), "": (None, 0)}
    batch = spark.createDataFrame([(" Ann ", D(2020, 1, 1)), ("ann", D(2020, 1, 1)), ("Bo", D(2020, 1, 1))], "n string, d date")
    assert entities.new_rows(batch, batch.filter("n = 'Bo'"), "n", "d").count() == 1


def test_prep(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, "a", True), (2, 3.0, 5.0, "b", False)], "k int, x double, c double, s string, f boolean")
    assert prep.numeric_columns(df, ["k"]) == ["x", "c"]
    scaler = prep.fit_scaler(df, ["x", "c"])
    assert scaler == {"x": (2.0, 1.0), "c": (5.0, 1.0)}
    shares = spark.createDataFrame([(1, "cut", 1.0), (1, "misc", 3.0), (2, "other", 1.0)], "k int, t string, n double")
    rows = {r.k: r for r in prep.category_shares(shares, ["k"], "t", "n").collect()}
    assert rows[1].pt_misc == 0.75 and rows[2].pt_misc == 0.0 and len(rows[1]) == 12
    assert profile.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_curves(spark):
    df = spark.createDataFrame([([0.1, 5.0, -2.0, 1.0, 0.0, 3.0],)], "z array<double>").withColumn("pmf", curves.softmax_pmf(F.col("z"), 2, 3))
    r = df.select("pmf", curves.survival(F.col("pmf")).alias("s"), curves.incidence(F.col("pmf"), 1).alias("c")).first()
    assert sum(map(sum, r.pmf)) == pytest.approx(1) and r.s[0] == 1 and r.s[-1] == pytest.approx(0, abs=1e-12) and len(r.c) == 4
    assert all(a >= b for a, b in zip(r.s, r.s[1:])) and all(a <= b for a, b in zip(r.c, r.c[1:]))
    assert curves.bins_within(365) == 12


def _pmf_rows(spark, rows):
    return spark.createDataFrame(rows, "t int, e int, pmf array<array<double>>")


def test_metrics_edges(spark):
    p = [[0.2, 0.3, 0.0], [0.1, 0.1, 0.1]]
    tied = _pmf_rows(spark, [(0, 1, p), (1, 1, p), (2, 0, p)])
    r = metrics.concordance(tied).first()
    assert (r.n_pairs, r.c_index) == (3, 0.5)
    censored = _pmf_rows(spark, [(0, 0, p), (2, 0, p)])
    assert metrics.concordance(censored).first().c_index == 0.5
    assert metrics.calibration(censored).count() == 0
    assert metrics.losses(censored).first().nll == 0
    assert metrics.chi_square_tail(16.919, 9) == pytest.approx(0.05, abs=1e-4)
    assert metrics.integrated(metrics.brier(_pmf_rows(spark, [(1, 0, p)]))).first().ibs is None


def test_rules_and_labels(spark):
    texts = ["He ruptured his Achilles", "Achilles soreness, questionable", "no Achilles issue", "full practice", "the weather", None, "tendinosis"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    voted = weaklabel.votes(df, "text")
    rows = {r.i: r.votes for r in voted.collect()}
    assert rows[0] == [-1] * 8 and rows[1][2] == 1 and rows[1][4] == 1 and rows[2][7] == 0 and rows[3][5] == 0 and rows[6][3] == 1
    label = {r.i: r.label for r in weaklabel.majority(voted).collect()}
    assert label[1] == 1 and label[4] == -1 and label[5] == -1
    tied = spark.createDataFrame([([0, 1, -1],), ([1, 1, 0],)], "votes array<int>")
    assert values(weaklabel.majority(tied), "label") == [-1, 1]
    probs = weaklabel.label_model(tied).collect()
    assert all(math.isclose(sum(r.probs), 1) for r in probs)
    report = weaklabel.classification_report(spark.createDataFrame([(0, 1), (1, 1)], "l int, p int"), "l", "p", [0, 1]).collect()
    assert [r.f1 for r in report] == [0.0, pytest.approx(2 / 3)]


def test_shapley_adds_up(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, -1.0, 0.5)], "k int, a double, b double")
    back = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 1.0)], "k int, a double, b double")
    score = lambda df: df.withColumn("score", F.col("a") * F.col("b") + 2 * F.col("a"))
    got = {r.k: r.s for r in attribution.shapley(rows, back, "k", ["a", "b"], score, 8).groupBy("k").agg(F.sum("phi").alias("s")).collect()}
    assert got == {1: pytest.approx(4 - 1.5), 2: pytest.approx(-2.5 - 1.5)}


def test_shapley_uses_the_whole_background(spark):
    rows = spark.createDataFrame([(1, 9.0, 1.0)], "k int, a double, b double")
    back = spark.createDataFrame([(float(i), float(i * i)) for i in range(8)], "a double, b double")
    score = lambda df: df.withColumn("score", F.col("a") * F.col("b"))
    for samples in (2, 8, 40):  # raised to a multiple of twice the background
        phi = {r.feature: r.phi for r in attribution.shapley(rows, back, "k", ["a", "b"], score, samples).collect()}
        assert sum(phi.values()) == pytest.approx(9 - sum(i**3 for i in range(8)) / 8)
        # the mean of both orders, which antithetic pairs give exactly for two features
        assert phi["a"] == pytest.approx(sum((9 - i) * (1 + i * i) / 2 for i in range(8)) / 8)
    with pytest.raises(ValueError):
        attribution.shapley(rows, back, "k", ["a", "b"], score, 8, most_background=7)


def test_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    columns = {"few": rng.normal(size=3), "one": np.array([4.0]), "ties": rng.integers(0, 4, 1001).astype(float), "many": rng.exponential(size=60_000), "flat": np.zeros(500)}
    rows = [(k, float(x)) for k, xs in columns.items() for x in xs] + [("few", None), ("none", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.feature, r.i): (r.value, r.n) for r in profile.quantiles(spark.createDataFrame(rows, "feature string, value double").repartition(4), shares).collect()}
    assert set(got) == {(k, i) for k in columns for i in range(len(shares))}
    for k, xs in columns.items():
        assert [got[k, i][0] for i in range(len(shares))] == pytest.approx(np.quantile(xs, shares).tolist()) and got[k, 0][1] == len(xs)
    assert profile.percentiles(spark.createDataFrame([], "x double"), "x", [0.5]).count() == 0


def test_controls_are_drawn_within_strata(spark):
    pool = spark.createDataFrame([(i, i % 5) for i in range(1000, 1500)] + [(1, 7), (2, 7)], "c int, s int").repartition(3)
    cases = spark.createDataFrame([(i, i % 5) for i in range(200)] + [(900, 7), (901, 8), (902, None)], "k int, s int")
    rows = cohort.match_controls(cases, pool.union(pool), ["s"], "k", "c").collect()
    taken = {}
    for r in rows:
        taken.setdefault(r.k, []).append((r.draw, r.c))
        assert r.s == (r.c % 5 if r.c >= 1000 else 7)
    assert all(sorted(d for d, _ in taken[k]) == [1, 2, 3] and len({c for _, c in taken[k]}) == 3 for k in range(200))
    assert sorted(c for _, c in taken[900]) == [1, 2] and 901 not in taken and 902 not in taken
    assert len({c for x in taken.values() for _, c in x}) > 300  # spread over the pool


def test_containment_of_short_names(spark):
    inner = spark.createDataFrame([("a", 1), ("bo", 2), ("kim", 3), ("", 4), ("zz", 5)], "_in string, i int")
    outer = spark.createDataFrame([("bob kim", 1), ("a", 2), ("bo", 3), ("", 4)], "_out string, o int")
    got = {(r.i, r.o) for r in entities.containing(inner, outer).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 1)}


def test_profiles_fan_out(spark):
    spine = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    people = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, p string")
    assert sorted(map(tuple, pit.static_join(spine, people, "k").collect()), key=repr) == sorted([(1, "a"), (1, "b"), (2, None), (None, None)], key=repr)


def test_filters(spark):
    df = spark.createDataFrame([("rupture", 2000, 1, D(2020, 1, 1)), ("tear", None, -1, D(2020, 1, 2)), (None, 1990, None, None)], "s string, y int, l int, d date")
    assert filters.primary_events(df, "s").count() == 1
    assert filters.active_since(df, "y", 1995).count() == 2
    assert filters.complete(df, "l", "d").count() == 2
    assert filters.decided(df, "l").count() == 1
    assert filters.known_by(df, "d", F.lit(D(2020, 1, 1))).count() == 1


def test_pages(spark):
    game = '<table id="pgl_basic"><thead><tr><th>R</th></tr></thead><tbody><tr><td data-stat="ranker">1</td><td data-stat="mp">35:42</td></tr><tr class="thead"><td data-stat="ranker">2</td></tr><tr><td data-stat="ranker">Rk</td></tr></tbody></table>'
    moves = '<table class="datatable center"><tr><td>&nbsp;Date </td><td>Team</td><td>Acquired</td><td>Relinquished</td><td>Notes</td></tr><tr><td>2020-01-01</td><td>X</td><td></td><td>• Al Bo</td><td>torn Achilles</td></tr><tr><td>2020-01-02</td><td>X</td><td>Cy</td><td></td><td>achilles healed</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>'
    index = '<table id="players"><tbody><tr><th data-stat="player"><a href="/players/b/bo.html">Al Bo</a></th><td data-stat="year_min">1999</td></tr><tr><th data-stat="player">none</th></tr></tbody></table>'
    foot = '<table id="per_game"><tfoot><tr><th>Career</th><td data-stat="g">70</td><td data-stat="lg">NBA</td></tr></tfoot></table>'
    df = spark.createDataFrame([("g", game), ("m?start=25", moves), ("i", index), ("c", foot), ("n", "<p>no</p>"), ("z", None)], "url string, html string")
    found = pg.tables(df)
    assert [r.record for r in pg.table_records(found, "^pgl_basic$", ranked="ranker").collect()] == [{"ranker": "1", "mp": "35:42"}]
    assert sorted((r.player_name, r.transaction_type) for r in pg.transactions(found).collect()) == [("Cy", "activated_from_IL"), ("• Al Bo", "placed_on_IL")]
    assert tuple(pg.entity_index(found, "https://x").first()) == ("Al Bo", "https://x/players/b/bo.html", 1999, None)
    r = pg.career_totals(found).first()
    assert r.career == {"career_g": "70", "career_lg": "NBA"} and r.numbers == {"career_g": 70.0}
    assert pg.pagination(df).filter("url like 'm%'").first().current_start == 25
    bio = spark.createDataFrame([("u", '<div id="meta"><p><strong>Position:</strong> Guard ▪ Shoots</p><p>6-9, 234lb</p><span id="necro-birth" data-birth="1984-12-30"></span><p>College: <a href="x">Duke</a></p><p>Draft: X, 1st round (3rd pick, 3rd overall), 2003 NBA, 1st pick</p></div>')], "url string, html string")
    b = pg.entity_bio(bio).first()
    assert (b.height_inches, b.weight_lbs, b.position, b.college, b.draft_year, b.draft_pick, b.birth_date) == (81, 234, "Guard", "Duke", 2003, 1, D(1984, 12, 30))
    stream = spark.createDataFrame([(1, 2021, '<p>early <a href="/players/a">Early Bird</a> achilles</p><strong>May 3, 2020</strong><p><a href="/teams/l">LA</a> placed <a href="/players/x">Al Bode</a>, torn achilles</p><strong>no date</strong><p><a href="/players/x">Bo</a> heel</p>')], "k int, y int, html string")
    rows = sorted((r.player_name, r.date, r.team, r.severity) for r in pg.paragraph_transactions(stream, "k", F.col("y")).collect())
    assert rows == [("Al Bode", D(2020, 5, 3), "LA", "rupture"), ("Early Bird", D(2020, 10, 1), "", "unspecified")]
    sick = spark.createDataFrame([("<table id='Injuries'><tbody><tr><td>• Al Bo</td><td>LA</td><td>bad</td><td>calf strain</td></tr><tr><td>B</td><td>C</td><td>D</td></tr></tbody></table>",)], "html string")
    assert tuple(pg.injuries(pg.tables(sick), 2020).first()) == ("Al Bo", D(2020, 6, 15), "LA", "calf strain", "tendinopathy")
    sheet = spark.createDataFrame([("f", [[" A", "b"], ["1", None], ["2"]])], "src string, c array<array<string>>")
    assert [r.record for r in pg.zip_header(sheet, "c", "src").collect()] == [{"a": "1", "b": ""}]


def test_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "2020-01-02"), ("b", "bad")], "n string, d string").write.option("header", True).csv(path)
    rows = {r.n: r.d for r in src.read_csv(spark, path, "n string, d date", ["d"]).collect()}
    assert rows == {"a": D(2020, 1, 2), "b": None}
    (tmp_path / "r.json").write_text('[{"n": "a", "d": "2020-01-02"},\n {"n": "b", "d": null}]')
    assert {r.n: r.d for r in src.read_json(spark, str(tmp_path / "r.json"), "n string, d date").collect()} == rows
    src.append_csv(spark.createDataFrame([("c", 1)], "n string, extra int"), path)
    assert spark.read.option("header", True).csv(path).count() == 3
    with pytest.raises(ValueError):
        src.overwrite(spark.read.csv(path), path)
    out = str(tmp_path / "o")
    src.overwrite(spark.read.option("header", True).csv(path), out)
    assert spark.read.option("header", True).csv(out).count() == 3
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "abc.html").write_text("<p>x</p>\n<p>y</p>")
    assert tuple(src.read_pages(spark, str(tmp_path / "pages")).first()) == ("abc", "<p>x</p>\n<p>y</p>")
    assert values(src.season_labels(spark, 2000, 2001), "label") == ["1999-00", "2000-01"]


def test_streaming(spark, tmp_path):
    from stridecast.streaming import loads

    data = str(tmp_path / "in")
    spark.createDataFrame([(1, dt.datetime(2020, 1, 1), 2.0), (1, dt.datetime(2020, 1, 2), 3.0), (1, dt.datetime(2020, 1, 20), 1.0)], "k int, ts timestamp_ntz, v double").write.parquet(data)
    stream = spark.readStream.schema("k int, ts timestamp_ntz, v double").parquet(data)
    q = loads.sliding_load(stream, "ts", "k", "v").writeStream.outputMode("append").format("memory").queryName("sliding").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(load) from sliding").first()[0] == 5.0
    q = loads.sessions(stream, "ts", "k").writeStream.outputMode("append").format("memory").queryName("runs").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("runs"), "n") == [2]
    names = str(tmp_path / "names")
    spark.createDataFrame([("a", D(2020, 1, 1)), ("A ", D(2020, 1, 1)), ("b", D(2020, 1, 1))], "n string, d date").write.parquet(names)
    out = str(tmp_path / "out")
    spark.createDataFrame([("b", D(2020, 1, 1))], "n string, d date").write.parquet(out)
    q = loads.append_new(spark.readStream.schema("n string, d date").parquet(names), out, str(tmp_path / "cp"), "n", "d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == 2
