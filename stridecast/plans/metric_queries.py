"""Queries of predictions: curves, concordance, Brier, calibration, losses, hazards, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridecast.functions import curves
from stridecast.operators import attribution, hazard, metrics
from stridecast.plans import adapters as a
from stridecast.plans.registry import query

B = a.BINS
PMF = f"""y AS (SELECT vec_id, CAST(label % 3 AS INTEGER) AS e, CAST(vec_id * 7 % {B} AS INTEGER) AS t, generate_subscripts(embedding, 1) - 1 AS k, exp(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {2 * B}),
p AS (SELECT vec_id, e, t, k // {B} + 1 AS cause, k % {B} AS bin, v / sum(v) OVER (PARTITION BY vec_id) AS p FROM y),
s AS (SELECT vec_id, any_value(e) AS e, any_value(t) AS t FROM y GROUP BY vec_id)"""
CENSOR = """c AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE e = 0) AS d FROM s GROUP BY t),
k AS (SELECT t, d, sum(n) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM c),
g AS (SELECT t, greatest(product(1 - d / r) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-6) AS g FROM k)"""
BRIER = f"""{PMF}, {CENSOR}, q AS (SELECT DISTINCT CAST(least(greatest(floor(unnest(quantile_cont(t, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))), 0), {B - 1}) AS INTEGER) AS tau FROM s),
h AS (SELECT tau, coalesce((SELECT arg_max(g, t) FROM g WHERE t <= tau), 1.0) AS gt FROM q),
f AS (SELECT vec_id, tau, sum(p) FILTER (WHERE cause = 1 AND bin <= tau) AS risk FROM p, q GROUP BY ALL),
l AS (SELECT h.tau, CASE WHEN s.t <= h.tau AND e = 1 THEN pow(1 - risk, 2) / g.g WHEN s.t > h.tau THEN pow(risk, 2) / gt END AS loss FROM s JOIN f USING (vec_id) JOIN h ON h.tau = f.tau JOIN g ON g.t = s.t),
b AS (SELECT tau, count(*) AS n, avg(loss) AS brier FROM l WHERE loss IS NOT NULL GROUP BY tau)"""
LOSS = f"""{PMF}, o AS (SELECT vec_id, sum(p) AS f FROM p WHERE bin <= t GROUP BY vec_id), x AS (SELECT s.*, f FROM s JOIN o USING (vec_id)),
n AS (SELECT sum(-ln(p + 1e-7)) / (SELECT count(*) FROM s) AS nll FROM p WHERE cause = e AND bin = t),
r AS (SELECT avg(exp(-(i.f - j.f) / 0.1)) AS ranking, count(*) AS n_pairs FROM x i JOIN x j ON i.e > 0 AND i.t < j.t)"""


@query(f"WITH {PMF} SELECT vec_id, CAST(cause AS INTEGER) AS cause, round(sum(p), 6) AS mass, round(max(p), 6) AS peak FROM p GROUP BY ALL")
def pmf_softmax(spark, sf_dir):
    rows = a.predictions(spark, sf_dir).select("vec_id", F.posexplode("pmf").alias("i", "row"))
    return rows.select("vec_id", (F.col("i") + 1).alias("cause"), F.round(curves.sum_of(F.col("row")), 6).alias("mass"), F.round(F.array_max("row"), 6).alias("peak"))


@query(f"WITH {PMF}, x AS (SELECT vec_id, bin + 1 AS step, 1 - sum(sum(p)) OVER (PARTITION BY vec_id ORDER BY bin) AS s FROM p GROUP BY vec_id, bin) SELECT vec_id, CAST(step AS INTEGER) AS step, round(s, 6) + 0.0 AS survival FROM x WHERE step < {B} UNION ALL SELECT vec_id, 0, 1.0 FROM s")
def survival_curve(spark, sf_dir):
    rows = a.predictions(spark, sf_dir).select("vec_id", F.posexplode(curves.survival(F.col("pmf"))).alias("step", "s"))
    return rows.filter(F.col("step") < B).select("vec_id", "step", (F.round("s", 6) + 0.0).alias("survival"))


@query(f"WITH {PMF}, x AS (SELECT vec_id, bin + 1 AS step, sum(p) OVER (PARTITION BY vec_id ORDER BY bin) AS s FROM p WHERE cause = 2) SELECT vec_id, CAST(step AS INTEGER) AS step, round(s, 6) AS incidence FROM x UNION ALL SELECT vec_id, 0, 0.0 FROM s")
def cumulative_incidence(spark, sf_dir):
    rows = a.predictions(spark, sf_dir).select("vec_id", F.posexplode(curves.incidence(F.col("pmf"), 2)).alias("step", "s"))
    return rows.select("vec_id", "step", F.round("s", 6).alias("incidence"))


@query(f"WITH {PMF} SELECT vec_id, round(sum(p) FILTER (WHERE cause = 1 AND bin < 6), 6) AS risk FROM p GROUP BY vec_id")
def horizon_risk(spark, sf_dir):
    return a.predictions(spark, sf_dir).select("vec_id", F.round(curves.horizon_risk(F.col("pmf"), 1, curves.bins_within(365, B)), 6).alias("risk"))


@query(f"""WITH {PMF}, r AS (SELECT vec_id, e, t, round(sum(p), 12) AS risk FROM p WHERE cause = 1 AND bin <= least((SELECT max(t) FROM s), {B - 1}) GROUP BY ALL),
c AS (SELECT CASE WHEN i.risk > j.risk THEN 1.0 WHEN i.risk = j.risk THEN 0.5 ELSE 0 END AS good FROM r i JOIN r j ON i.e = 1 AND j.t > i.t)
SELECT count(*) AS n_pairs, CAST(coalesce(sum(good), 0) AS DOUBLE) AS concordant, round(CASE WHEN count(*) > 0 THEN avg(good) ELSE 0.5 END, 6) AS c_index FROM c""")
def c_index(spark, sf_dir):
    return metrics.concordance(a.predictions(spark, sf_dir)).withColumn("c_index", F.round("c_index", 6))


@query(f"WITH {PMF}, {CENSOR} SELECT t, round(g, 6) AS g FROM g")
def censoring_curve(spark, sf_dir):
    return metrics.censoring_curve(a.predictions(spark, sf_dir)).withColumn("g", F.round("g", 6))


@query(f"WITH {BRIER} SELECT tau, n, round(brier, 6) AS brier FROM b")
def brier(spark, sf_dir):
    return metrics.brier(a.predictions(spark, sf_dir)).withColumn("brier", F.round("brier", 6))


@query(f"WITH {BRIER}, z AS (SELECT tau, (tau - lag(tau) OVER (ORDER BY tau)) * (brier + lag(brier) OVER (ORDER BY tau)) / 2 AS part FROM b) SELECT round(sum(part) / (max(tau) - min(tau)), 6) AS ibs FROM z")
def integrated_brier(spark, sf_dir):
    return metrics.integrated(metrics.brier(a.predictions(spark, sf_dir))).withColumn("ibs", F.round("ibs", 6))


@query(f"""WITH {PMF}, r AS (SELECT vec_id, CASE WHEN e = 1 THEN 1 ELSE 0 END AS hit, sum(p) AS risk FROM p WHERE cause = 1 AND bin <= t GROUP BY ALL),
q AS (SELECT quantile_cont(risk, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, sum(hit) AS a FROM r)
SELECT CAST(len(list_filter(q, lambda x: risk > x)) AS INTEGER) AS bin, count(*) AS n, CAST(sum(hit) AS BIGINT) AS observed, round(sum(risk), 6) AS expected, round(sum(hit) / any_value(a), 6) AS observed_rate, round(sum(risk) / any_value(a), 6) AS expected_rate FROM r, q GROUP BY ALL""")
def calibration(spark, sf_dir):
    return metrics.calibration(a.predictions(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("expected", "observed_rate", "expected_rate")})


# the lower incomplete gamma function by its series, for 9 degrees of freedom
@query(f"""WITH {PMF}, r AS (SELECT vec_id, CASE WHEN e = 1 THEN 1 ELSE 0 END AS hit, sum(p) AS risk FROM p WHERE cause = 1 AND bin <= t GROUP BY ALL),
q AS (SELECT quantile_cont(risk, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM r),
b AS (SELECT len(list_filter(q, lambda x: risk > x)) AS bin, sum(hit) AS o, sum(risk) AS x FROM r, q GROUP BY ALL),
c AS (SELECT sum((o - x) * (o - x) / x) AS chi2 FROM b WHERE x > 0)
SELECT round(chi2, 4) AS chi2, round(1 - (SELECT sum(exp((4.5 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(5.5 + k))) FROM (SELECT unnest(generate_series(0, 2000)) AS k)), 6) + 0.0 AS p FROM c""")
def calibration_test(spark, sf_dir):
    bins = metrics.calibration(a.predictions(spark, sf_dir))
    found = metrics.calibration_test(bins)
    return bins.agg(F.round(F.lit(found.get("chi2")).cast("double"), 4).alias("chi2"), (F.round(F.lit(found.get("p")).cast("double"), 6) + 0.0).alias("p"))


@query(f"WITH {LOSS} SELECT round(nll, 6) AS nll, round(ranking, 4) AS ranking, n_pairs, round((nll + ranking) / 2, 4) AS combined FROM n, r")
def losses(spark, sf_dir):
    return metrics.losses(a.predictions(spark, sf_dir)).select(F.round("nll", 6).alias("nll"), F.round("ranking", 4).alias("ranking"), "n_pairs", F.round("combined", 4).alias("combined"))


@query(f"""WITH {PMF}, c AS (SELECT vec_id % 2 AS arm, t, count(*) AS n, count(*) FILTER (WHERE e > 0) AS d FROM s GROUP BY ALL),
k AS (SELECT arm, t, d, sum(n) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM c),
v AS (SELECT *, product(1 - d / r) OVER w AS sv, sum(CASE WHEN r > d THEN d / (r * (r - d)) END) OVER w AS gr FROM k WINDOW w AS (PARTITION BY arm ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN sv > 0 AND sv < 1 THEN 1.959963984540054 * sqrt(gr) / abs(ln(sv)) END AS w FROM v)
SELECT arm, t, CAST(r AS BIGINT) AS at_risk, d AS events, round(sv, 6) AS survival, round(CASE WHEN sv = 1 THEN 1.0 ELSE pow(sv, exp(w)) END, 6) AS low, round(CASE WHEN sv = 1 THEN 1.0 ELSE pow(sv, exp(-w)) END, 6) AS high FROM b WHERE sv > 1e-9""")
def event_free_curve(spark, sf_dir):
    rows = a.predictions(spark, sf_dir).withColumn("arm", F.col("vec_id") % 2)
    return metrics.event_free_curve(rows, ["arm"]).filter("survival > 1e-9").withColumns({c: F.round(c, 6) for c in ("survival", "low", "high")})


@query(f"""WITH {LOSS}, {BRIER.removeprefix(PMF + ", ")}, z AS (SELECT tau, (tau - lag(tau) OVER (ORDER BY tau)) * (brier + lag(brier) OVER (ORDER BY tau)) / 2 AS part FROM b),
u AS (SELECT vec_id, e, t, round(sum(p), 12) AS risk FROM p WHERE cause = 1 AND bin <= least((SELECT max(t) FROM s), {B - 1}) GROUP BY ALL)
SELECT round((SELECT avg(CASE WHEN i.risk > j.risk THEN 1.0 WHEN i.risk = j.risk THEN 0.5 ELSE 0 END) FROM u i JOIN u j ON i.e = 1 AND j.t > i.t), 4) AS c_index,
round((SELECT sum(part) / (max(tau) - min(tau)) FROM z), 4) AS ibs, round((SELECT nll FROM n), 4) AS nll, round(ranking, 4) AS ranking, round(((SELECT nll FROM n) + ranking) / 2, 4) AS combined FROM r""")
def evaluation_report(spark, sf_dir):
    """The report, read back from its JSON."""
    names = ["c_index", "ibs", "nll", "ranking", "combined"]
    found = metrics.evaluation_report(a.predictions(spark, sf_dir))
    return found.select(F.from_json("report", ", ".join(f"{n} double" for n in names)).alias("r")).select(*(F.col("r")[n].alias(n) for n in names))


_FEATURES = [f"f{i}" for i in range(8)]


@query("""WITH s AS (SELECT CAST(vec_id * 7 % 12 AS INTEGER) AS t, CAST(label % 3 AS INTEGER) AS e, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), r AS (SELECT t, e, x, CAST(unnest(generate_series(0, least(t, 9))) AS INTEGER) AS b FROM s)
SELECT b, CAST(CASE WHEN b = t AND e BETWEEN 1 AND 2 THEN e ELSE 0 END AS DOUBLE) AS y, count(*) AS n, round(sum(x), 4) + 0.0 AS x FROM r GROUP BY ALL""")
def person_periods(spark, sf_dir):
    """The rows that hazards are fitted on, over ten bins, counted by bin and outcome."""
    rows = a.survival_rows(spark, sf_dir).join(a.table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x")), "vec_id")
    return hazard.person_periods(rows, ["x"], 10, 2).groupBy("b", "y").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 4) + 0.0).alias("x"))


@query()
def hazard_pmf(spark, sf_dir):
    rows = a.survival_rows(spark, sf_dir)
    model = hazard.fit_hazards(rows, _FEATURES, 12, 2)
    return model.score(rows).select("vec_id", "t", "e", F.round(curves.horizon_risk(F.col("pmf"), 1, 12), 4).alias("risk"), F.round(curves.sum_of(curves.over_causes(F.col("pmf"))), 4).alias("any_risk"))


_SURVIVAL = "o AS (SELECT vec_id, CAST(vec_id * 7 % 12 AS INTEGER) AS t, CAST(label % 3 AS INTEGER) AS e, " + ", ".join(f"{' + '.join(f'CAST(embedding[{8 * i + j}] AS DOUBLE)' for j in range(1, 9))} AS x{i}" for i in range(2)) + " FROM embeddings)"


def _fit_sql(name: str, rows: str, regularisation: float, steps: int) -> str:
    """Newton steps of two features on the rows, each a CTE: NAMEw0, ... of weights, NAMEr0, ... of sums over risk sets, NAMEn0, ... of gradient,
    curvature and log-likelihood."""
    z = f"""{name}m AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS d0, avg(x1) AS m1, stddev_pop(x1) AS d1, count(*) * {regularisation!r} AS reg FROM {rows}),
{name}z AS MATERIALIZED (SELECT vec_id, least(t, 11) AS last, CASE WHEN t < 12 AND e BETWEEN 1 AND 2 THEN e ELSE 0 END AS y, (x0 - m0) / d0 AS x0, (x1 - m1) / d1 AS x1 FROM {rows}, {name}m),
{name}d AS (SELECT y AS c, last AS b, count(*) AS k FROM {name}z WHERE y > 0 GROUP BY ALL), {name}g AS (SELECT y AS c, sum(x0) AS g0, sum(x1) AS g1 FROM {name}z WHERE y > 0 GROUP BY y),
{name}w0 AS (SELECT c, CAST(0 AS DOUBLE) AS a0, CAST(0 AS DOUBLE) AS a1 FROM (SELECT unnest([1, 2]) AS c))"""
    for k in range(steps):
        z += f""",
{name}r{k} AS MATERIALIZED (SELECT c, b, k, sum(h) AS s, sum(h * x0) AS s0, sum(h * x1) AS s1, sum(h * x0 * x0) AS s00, sum(h * x0 * x1) AS s01, sum(h * x1 * x1) AS s11
  FROM (SELECT w.c, d.b, d.k, x0, x1, exp(a0 * x0 + a1 * x1) AS h FROM {name}w{k} w JOIN {name}d d ON d.c = w.c JOIN {name}z z ON z.last >= d.b) GROUP BY c, b, k),
{name}n{k} AS MATERIALIZED (SELECT r.c, any_value(a0) AS a0, any_value(a1) AS a1, any_value(g0) - sum(k * s0 / s) - any_value(reg * a0) AS q0, any_value(g1) - sum(k * s1 / s) - any_value(reg * a1) AS q1,
  sum(k * (s00 / s - s0 * s0 / s / s)) + any_value(reg) AS h00, sum(k * (s01 / s - s0 * s1 / s / s)) AS h01, sum(k * (s11 / s - s1 * s1 / s / s)) + any_value(reg) AS h11,
  any_value(g0 * a0 + g1 * a1) - sum(k * ln(s)) - any_value(reg / 2 * (a0 * a0 + a1 * a1)) AS value FROM {name}r{k} r JOIN {name}w{k} w USING (c) JOIN {name}g USING (c), {name}m GROUP BY r.c),
{name}w{k + 1} AS MATERIALIZED (SELECT c, a0 + (h11 * q0 - h01 * q1) / (h00 * h11 - h01 * h01) AS a0, a1 + (h00 * q1 - h01 * q0) / (h00 * h11 - h01 * h01) AS a1 FROM {name}n{k})"""
    return z


def _risk_sql(name: str, fit: str, steps: int, rows: str) -> str:
    """NAMEp: vec_id, c, b, p of rows, by the fit's last evaluation."""
    last = steps - 1
    return f"""{name}s AS (SELECT vec_id, c, exp(a0 * (x0 - m0) / d0 + a1 * (x1 - m1) / d1) AS score FROM {rows}, {fit}m, {fit}w{last}),
{name}h AS (SELECT vec_id, c, b, coalesce(k / r.s, 0) * score AS h FROM {name}s CROSS JOIN (SELECT unnest(generate_series(0, 11)) AS b) LEFT JOIN {fit}r{last} r USING (c, b)),
{name}t AS (SELECT vec_id, b, sum(h) AS h, sum(sum(h)) OVER (PARTITION BY vec_id ORDER BY b) - sum(h) AS before FROM {name}h GROUP BY vec_id, b),
{name}p AS (SELECT x.vec_id, x.c, x.b, CASE WHEN t.h > 0 THEN exp(-before) * (1 - exp(-t.h)) / t.h * x.h ELSE 0 END AS p FROM {name}h x JOIN {name}t t USING (vec_id, b))"""


_STEPS = 6


@query(f"WITH {_SURVIVAL}, {_fit_sql('f', 'o', 0.01, 4)} " + " UNION ALL ".join(f"SELECT {k} AS step, c AS cause, round(a0, 6) + 0.0 AS w0, round(a1, 6) + 0.0 AS w1, round((SELECT sum(value) FROM fn{k}), 4) AS value FROM fn{k}" for k in range(4)))
def hazard_fit(spark, sf_dir):
    """Four evaluations of a fit of two features: weights and penalised log-likelihood before and after each Newton step."""
    model = hazard.fit_grid(a.survival_rows(spark, sf_dir), _FEATURES[:2], 12, 2, (0.01,), 4, 0.0)[0]
    rows = [(step, c + 1, w[0], w[1], value) for step, (value, weights) in enumerate(model.steps) for c, w in enumerate(weights)]
    found = spark.createDataFrame(rows, "step int, cause int, w0 double, w1 double, value double")
    return found.select("step", "cause", *((F.round(w, 6) + 0.0).alias(w) for w in ("w0", "w1")), F.round("value", 4).alias("value"))


@query(f"WITH {_SURVIVAL}, {_fit_sql('f', 'o', 0.001, _STEPS)}, {_risk_sql('q', 'f', _STEPS, 'o')} SELECT vec_id, round(sum(p) FILTER (WHERE c = 1), 5) AS risk, round(sum(p), 5) AS any_risk FROM qp GROUP BY vec_id")
def hazard_risk(spark, sf_dir):
    """Risks by a fit of two features."""
    rows = a.survival_rows(spark, sf_dir)
    model = hazard.fit_hazards(rows, _FEATURES[:2], 12, 2)
    return model.score(rows).select("vec_id", F.round(curves.horizon_risk(F.col("pmf"), 1, 12), 5).alias("risk"), F.round(curves.sum_of(curves.over_causes(F.col("pmf"))), 5).alias("any_risk"))


_GRID = [1e-3, 1.0]
_SPLIT = {k: f"{k} AS (SELECT * FROM o WHERE vec_id // 12 % 4 {c})" for k, c in (("tr", "> 1"), ("va", "= 1"), ("te", "= 0"))}


def _index_sql(name: str, risk: str, rows: str) -> str:
    return f"""{name}u AS (SELECT o.vec_id, o.t, o.e, round(sum(p), 12) AS risk FROM {risk}p p JOIN {rows} o USING (vec_id) WHERE c = 1 AND b <= least((SELECT max(t) FROM {rows}), 11) GROUP BY ALL),
{name}c AS (SELECT coalesce(avg(CASE WHEN i.risk > j.risk THEN 1.0 WHEN i.risk = j.risk THEN 0.5 ELSE 0 END), 0.5) AS c_index FROM {name}u i JOIN {name}u j ON i.e = 1 AND j.t > i.t)"""


@query(f"""WITH {_SURVIVAL}, {", ".join(_SPLIT.values())}, {", ".join(f"{_fit_sql(f'f{i}x', 'tr', g, _STEPS)}, {_risk_sql(f'q{i}x', f'f{i}x', _STEPS, 'va')}, {_index_sql(f'v{i}x', f'q{i}x', 'va')}, {_risk_sql(f't{i}x', f'f{i}x', _STEPS, 'te')}, {_index_sql(f'z{i}x', f't{i}x', 'te')}" for i, g in enumerate(_GRID))},
b AS (SELECT v0xc.c_index AS v0, v1xc.c_index AS v1 FROM v0xc, v1xc)
SELECT CAST(CASE WHEN v0 >= v1 THEN {_GRID[0]!r} ELSE {_GRID[1]!r} END AS DOUBLE) AS regularisation, round(v0, 6) AS val_0, round(v1, 6) AS val_1, round(CASE WHEN v0 >= v1 THEN (SELECT c_index FROM z0xc) ELSE (SELECT c_index FROM z1xc) END, 6) AS test_c_index FROM b""")
def sweep(spark, sf_dir):
    """Two points of a grid, fitted together on half of the rows, chosen on a quarter and tested on the last one."""
    rows = a.survival_rows(spark, sf_dir).withColumn("split", F.floor(F.col("vec_id") / 12) % 4)
    best, tried, model = hazard.sweep(rows.filter("split > 1"), rows.filter("split = 1"), _FEATURES[:2], _GRID, 12)
    test = metrics.concordance(model.score(rows.filter("split = 0")))
    return test.select(F.lit(best).alias("regularisation"), *(F.lit(round(t["c_index"], 6)).alias(f"val_{i}") for i, t in enumerate(tried)), F.round("c_index", 6).alias("test_c_index"))


def _background(rows):
    return rows.orderBy("vec_id").limit(8)  # the sample is the feature: a fixed background


@query()
def shapley_risk(spark, sf_dir):
    rows = a.survival_rows(spark, sf_dir)
    model = hazard.fit_hazards(rows, _FEATURES, 12, 2)
    score = lambda df: model.score(df).withColumn("score", curves.horizon_risk(F.col("pmf"), 1, 4))
    return attribution.shapley(rows, _background(rows), "vec_id", _FEATURES, score).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


_PARTS = [f"{' + '.join(f'CAST(embedding[{8 * i + j}] AS DOUBLE)' for j in range(1, 9))}" for i in range(8)]
_LONG = " UNION ALL ".join(f"SELECT vec_id, {i} AS i, {p} AS x FROM embeddings" for i, p in enumerate(_PARTS))


# of a linear score a feature's part is its weight times what it differs from the background's mean
@query(f"""WITH x AS ({_LONG}), b AS (SELECT i, avg(x) AS m FROM x WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8) GROUP BY i)
SELECT vec_id, 'f' || i AS feature, round((i - 2.5) * (x - m), 6) + 0.0 AS phi FROM x JOIN b USING (i)""")
def shapley(spark, sf_dir):
    rows = a.survival_rows(spark, sf_dir)
    score = lambda df: df.withColumn("score", sum(((i - 2.5) * F.col(f) for i, f in enumerate(_FEATURES)), F.lit(0.25)))
    return attribution.shapley(rows, _background(rows), "vec_id", _FEATURES, score).withColumn("phi", F.round("phi", 6) + 0.0)


# each background row is drawn as often as any other, so that phi is exact, and all rows go on to the last round, of 40 + 80 pairs
@query(f"""WITH x AS ({_LONG}), b AS (SELECT i, avg(x) AS m, var_pop(x) AS v FROM x WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 40) GROUP BY i)
SELECT vec_id, 'f' || i AS feature, round((i - 2.5) * (x - m), 6) + 0.0 AS phi, round(1.959963984540054 * abs(i - 2.5) * sqrt(v / 119), 6) AS error, CAST(120 AS BIGINT) AS n_pairs FROM x JOIN b USING (i)""")
def shapley_bounded(spark, sf_dir):
    """Attributions of a linear score with their errors, over a background of 40 rows."""
    rows = a.survival_rows(spark, sf_dir)
    score = lambda df: df.withColumn("score", sum(((i - 2.5) * F.col(f) for i, f in enumerate(_FEATURES)), F.lit(0.25)))
    found = attribution.bounded_shapley(rows, rows.orderBy("vec_id").limit(40), "vec_id", _FEATURES, score, 1e-9, 2)
    return found.select("vec_id", "feature", (F.round("phi", 6) + 0.0).alias("phi"), F.round("error", 6).alias("error"), "n_pairs")
