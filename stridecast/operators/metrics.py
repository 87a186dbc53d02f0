"""Evaluation of competing-risk predictions: rows of (t: time bin, e: 0 censored or cause, pmf)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridecast.functions.curves import horizon_risk, over_causes, sum_of
from stridecast.operators.profile import quantiles
from stridecast.sources.shared import written


#: Ranges that risks are cut into.
RANGES = 64
#: Up to so many counts (32 bytes each) are merged on the driver, more in tasks; the results are the same.
FEW = 50_000


def last_bin(rows: DataFrame) -> tuple[int, int] | None:
    """(largest t, bins of the predictions); reads t and the size of one row of each pmf."""
    found = rows.agg(F.max("t").alias("m"), F.max(F.size(F.get("pmf", F.lit(0)))).alias("bins")).first()
    return None if found is None or found["m"] is None or found["bins"] is None else (found["m"], found["bins"])


def own_time_risk(pmf: Column, cause: int, last: Column) -> Column:
    """The cause's probability up to bin `last`, itself included."""
    return horizon_risk(pmf, cause, last + 1)


def earlier_and_lower(t: np.ndarray, risk: np.ndarray, members: np.ndarray, asking: np.ndarray) -> float:
    """Over all pairs of an asking row and a member of a later t: the number of those with a lower risk, and half of those of the same.
    Rows count `members` and `asking` times. A merge by the bits of t, so n log n however many values it has."""
    place = np.unique(t, return_inverse=True)[1].ravel()
    good = 0.0
    for bit in range(int(place.max()).bit_length() if len(place) else 0):
        group, upper = place >> (bit + 1), place >> bit & 1
        order = np.lexsort((risk, group))
        g, r, weight = group[order], risk[order], np.where(upper[order] == 1, members[order], 0)
        below = np.concatenate([[0], np.cumsum(weight)])
        new_group = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        new_run = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])))
        run = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))) - 1
        ends = np.append(new_run[1:], len(g))
        less = below[new_run[run]] - below[new_group[np.searchsorted(new_group, np.arange(len(g)), side="right") - 1]]
        same = below[ends[run]] - below[new_run[run]]
        good += float(np.where(upper[order] == 0, asking[order] * (less + same / 2), 0).sum())
    return good


def rank_counts(counts: DataFrame, ranges: int = RANGES) -> tuple[int, float]:
    """(pairs, concordant) of counts: t, risk, members, cases, a row for each t and risk.

    Risks are cut into ranges of about equal numbers of rows. What lies in different ranges follows from a matrix of counts by t and
    range, which alone reaches the driver; what shares a range is merged there, one group a range. Few counts (FEW) are merged at once.
    """
    if counts.count() <= FEW:
        rows = counts.toArrow()
        t, risk, members, cases = (rows[c].to_numpy() for c in ("t", "risk", "members", "cases"))
        later = np.concatenate([[0], np.cumsum(members[np.argsort(t)])])
        return sum(int(k) * int(later[-1] - n) for k, n in zip(cases, later[np.searchsorted(np.sort(t), t, side="right")])), earlier_and_lower(t, risk, members, cases)
    cuts = counts.agg(F.percentile_approx("risk", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first()["cuts"] or []
    place = F.size(F.filter(F.lit([float(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col("risk")))
    dealt = counts.withColumn("range", place)
    cells = dealt.groupBy("t", "range").agg(F.sum("members").alias("members"), F.sum("cases").alias("cases")).collect()
    if not cells:
        return 0, 0.0
    times = sorted({c.t for c in cells})
    at = {t: i for i, t in enumerate(times)}
    members, cases = np.zeros((2, len(times), len(cuts) + 1))
    for c in cells:
        members[at[c.t], c.range], cases[at[c.t], c.range] = c.members, c.cases
    later = np.vstack([members[::-1].cumsum(axis=0)[::-1][1:], np.zeros((1, members.shape[1]))])
    lower = np.hstack([np.zeros((len(times), 1)), later.cumsum(axis=1)[:, :-1]])
    pairs = sum(int(a) * int(b) for a, b in zip(cases.sum(axis=1), later.sum(axis=1)))

    def inside(key, rows):
        column = lambda c: np.asarray(rows[c].combine_chunks())
        return pa.table({"good": [earlier_and_lower(column("t"), column("risk"), column("members"), column("cases"))]})

    within = dealt.groupBy("range").applyInArrow(inside, "good double").agg(F.sum("good").alias("good")).first()["good"] or 0.0
    return pairs, float((cases * lower).sum()) + within


def concordance(rows: DataFrame, cause: int = 1) -> DataFrame:
    """n_pairs, concordant, c_index: of the pairs of a case and anyone whose time is later, the share in which the
    case's risk is higher, ties half; 0.5 without pairs.

    No pair is made: risks are rounded to 12 digits, counted by (t, risk) in one scan of the predictions, written, and ranked from
    there (rank_counts).
    """
    spark, last = rows.sparkSession, last_bin(rows)
    pairs, good = 0, 0.0
    if last is not None:
        risk = F.round(own_time_risk(F.col("pmf"), cause, F.lit(min(last[0], last[1] - 1))), 12)
        case = ((F.col("e") == cause) & (F.col("t") < last[0])).cast("long")
        counts = rows.select("t", case.alias("case"), risk.alias("risk")).filter("t is not null and risk is not null")
        pairs, good = rank_counts(written(counts.groupBy("t", "risk").agg(F.count("*").alias("members"), F.sum("case").alias("cases"))))
    return spark.createDataFrame([(pairs, good, good / pairs if pairs else 0.5)], "n_pairs long, concordant double, c_index double")


def kaplan_meier(rows: DataFrame, event: Column, floor: float = 0.0, strata: list[str] = ()) -> DataFrame:
    """t, at_risk, events, survival (t included), by strata: one row a time, after an aggregation by time."""
    counts = rows.groupBy(*strata, "t").agg(F.count("*").alias("n"), F.sum(F.when(event, 1).otherwise(0)).alias("events"))
    by = Window.partitionBy(*strata).orderBy("t") if strata else Window.orderBy("t")
    at_risk = F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing))
    stepped = counts.withColumn("at_risk", at_risk)
    curve = F.product(1 - F.col("events") / F.col("at_risk")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.select(*strata, "t", "at_risk", "events", F.greatest(curve, F.lit(floor)).alias("survival"))


def censoring_curve(rows: DataFrame) -> DataFrame:
    """t, g: the probability of not being censored up to t, 1e-6 at least."""
    return kaplan_meier(rows, F.col("e") == 0, 1e-6).select("t", F.col("survival").alias("g"))


def event_free_curve(rows: DataFrame, strata: list[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """The curve of any event, with a log-log band from Greenwood's sum."""
    curve = kaplan_meier(rows, F.col("e") > 0, 0.0, strata)
    by = (Window.partitionBy(*strata).orderBy("t") if strata else Window.orderBy("t")).rowsBetween(Window.unboundedPreceding, 0)
    d, n, s = F.col("events"), F.col("at_risk"), F.col("survival")
    green = F.sum(F.when(n > d, d / (n * (n - d)))).over(by)
    width = F.when((s > 0) & (s < 1), z * F.sqrt(green) / F.abs(F.log(s)))
    return curve.withColumn("low", F.when(s == 1, 1.0).otherwise(F.pow(s, F.exp(width)))).withColumn("high", F.when(s == 1, 1.0).otherwise(F.pow(s, F.exp(-width))))


def by_time(rows: DataFrame, sigma: float = 0.1) -> list:
    """One row a time: t, n, censored, events and sums for the losses, and the largest size of the predictions. One scan."""
    last = F.least(F.col("t"), F.size(F.get("pmf", F.lit(0))) - 1)
    own = sum_of(F.slice(over_causes(F.col("pmf")), F.lit(1), last + 1))
    at = F.get(F.get("pmf", F.col("e") - 1), last)
    event = F.col("e") > 0
    scored = rows.select("t", "e", own.alias("f"), F.when(event, -F.log(at + 1e-7)).otherwise(0.0).alias("nll"), F.size(F.get("pmf", F.lit(0))).alias("bins"))
    sums = scored.filter("t is not null").groupBy("t").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("e") == 0, 1).otherwise(0)).alias("censored"), F.sum(F.when(event, 1).otherwise(0)).alias("events"), F.max("bins").alias("bins"),
        F.sum("nll").alias("nll"), F.sum(F.when(event, F.exp(-F.col("f") / sigma)).otherwise(0.0)).alias("falls"), F.sum(F.exp(F.col("f") / sigma)).alias("rises"),
    )
    return sorted(sums.collect(), key=lambda r: r.t)


def _survivals(times: list, floor: float = 1e-6) -> list[float]:
    """The probability of not being censored up to each time."""
    left, curve, out = sum(r.n for r in times), 1.0, []
    for r in times:
        curve *= 1 - r.censored / left
        left -= r.n
        out.append(max(curve, floor))
    return out


def _deciles(times: list, n_bins: int) -> list[int]:
    """The distinct deciles of t, as whole bins within the prediction."""
    n = sum(r.n for r in times)
    ends = np.cumsum([r.n for r in times])
    rank = lambda k: times[int(np.searchsorted(ends, k, side="right"))].t
    found = set()
    for s in range(1, 10):
        at = s / 10 * (n - 1)
        low, high = rank(math.floor(at)), rank(math.ceil(at))
        found.add(min(max(int(low + (high - low) * (at - math.floor(at))), 0), n_bins - 1))
    return sorted(found)


def _weighted_losses(times: list, cause: int, n_bins: int) -> list[tuple[int, Column]]:
    """(tau, a row's loss at it, null where it is left out)."""
    survivals = _survivals(times)
    g_at = F.create_map(*(F.lit(x) for r, g in zip(times, survivals) for x in (r.t, g)))
    out = []
    for tau in _deciles(times, n_bins):
        upto = [g for r, g in zip(times, survivals) if r.t <= tau]
        risk = own_time_risk(F.col("pmf"), cause, F.lit(tau))
        loss = F.when((F.col("t") <= tau) & (F.col("e") == cause), F.pow(1 - risk, F.lit(2.0)) / g_at[F.col("t")]).when(F.col("t") > tau, F.pow(risk, F.lit(2.0)) / (upto[-1] if upto else 1.0))
        out.append((tau, loss))
    return out


def _brier_rows(spark, sums: dict[int, tuple[int, float]]) -> DataFrame:
    return spark.createDataFrame([(tau, n, total / n) for tau, (n, total) in sums.items() if n], "tau int, n long, brier double")


def brier(rows: DataFrame, cause: int = 1, n_bins: int | None = None) -> DataFrame:
    """tau, n, brier: inverse-probability-weighted squared error at each decile of t.

    An event of the cause by tau weighs 1 / G(its time), a later time 1 / G(tau); others are left out; the sum is divided by
    the number of rows taken. Two scans: counts by time, from which curve and times follow on the driver, and one aggregate of the losses.
    """
    times = by_time(rows)
    if not times:
        return _brier_rows(rows.sparkSession, {})
    parts = _weighted_losses(times, cause, n_bins or max(r.bins for r in times))
    found = rows.agg(*(f(loss).alias(f"{n}{tau}") for tau, loss in parts for n, f in (("n", F.count), ("s", F.sum)))).first()
    return _brier_rows(rows.sparkSession, {tau: (found[f"n{tau}"], found[f"s{tau}"]) for tau, _ in parts})


def integrated(scores: DataFrame, x: str = "tau", y: str = "brier") -> DataFrame:
    """ibs: the trapezoid over the times divided by their range; null for fewer than two. A handful of rows."""
    by = Window.orderBy(x)
    area = (F.col(x) - F.lag(x).over(by)) * (F.col(y) + F.lag(y).over(by)) / 2
    parts = scores.filter(F.col(y).isNotNull()).withColumn("_a", area)
    return parts.agg((F.sum("_a") / F.when(F.max(x) > F.min(x), F.max(x) - F.min(x))).alias("ibs"))


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for chi squared: the regularised upper gamma function, by series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale_ = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale_
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale_ * h


def calibration(rows: DataFrame, cause: int = 1, n_bins: int = 10) -> DataFrame:
    """bin, n, observed, expected, observed_rate, expected_rate: bins of the risk at a row's own time, cut at its
    percentiles (left open, the outer edges widened by 1e-6). Rates are shares of all observed events; empty without any."""
    last = F.least(F.col("t"), F.size(F.get("pmf", F.lit(0))) - 1)
    scored = written(rows.select((F.col("e") == cause).cast("int").alias("hit"), own_time_risk(F.col("pmf"), cause, last).alias("risk")))
    inner = quantiles(scored.select(F.lit("risk").alias("feature"), F.col("risk").alias("value")), [i / n_bins for i in range(1, n_bins)])
    edges = inner.agg(F.collect_list("value").alias("edges")).crossJoin(F.broadcast(scored.agg(F.sum("hit").alias("all"))))  # one row each
    joined = scored.crossJoin(F.broadcast(edges)).filter(F.col("all") > 0)
    place = F.size(F.filter("edges", lambda x: F.col("risk") > x))
    counted = joined.groupBy(place.alias("bin"), "all").agg(F.count("*").alias("n"), F.sum("hit").alias("observed"), F.sum("risk").alias("expected"))
    return counted.select("bin", "n", "observed", "expected", (F.col("observed") / F.col("all")).alias("observed_rate"), (F.col("expected") / F.col("all")).alias("expected_rate"))


def calibration_test(bins: DataFrame, df: int = 9) -> dict[str, float]:
    """chi2 and p of the ten bins: a sum of ten rows, its tail on the driver."""
    chi2 = bins.filter("expected > 0").agg(F.sum(F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("expected")).alias("x")).first()["x"]
    return {} if chi2 is None else {"chi2": chi2, "p": chi_square_tail(chi2, df)}


def _losses(times: list, alpha: float = 0.5) -> tuple[float | None, float, float | None, int]:
    n, after, members, nll, ranking, pairs = sum(r.n for r in times), 0.0, 0, 0.0, 0.0, 0
    for r in reversed(times):
        ranking += r.falls * after
        pairs += r.events * members
        after += r.rises
        members += r.n
        nll += r.nll
    nll, ranking = nll / n if n else None, ranking / pairs if pairs else 0.0
    return nll, ranking, None if nll is None else alpha * nll + (1 - alpha) * ranking, pairs


def losses(rows: DataFrame, sigma: float = 0.1, alpha: float = 0.5) -> DataFrame:
    """nll, ranking, combined, n_pairs.

    nll: -log(pmf[cause][t] + 1e-7) of events, 0 of the censored, mean over all. ranking: the mean over pairs (event i,
    later j) of exp(-(F_i - F_j) / sigma), F being the incidence of any cause at a row's own time; it factorises
    into sums by time, so a suffix over the bins takes the place of the pairs.
    """
    return rows.sparkSession.createDataFrame([_losses(by_time(rows, sigma), alpha)], "nll double, ranking double, combined double, n_pairs long")


def evaluation_report(rows: DataFrame, cause: int = 1) -> DataFrame:
    """One row of all metrics, rounded to 4 digits, and the same as JSON. Two scans of the predictions: sums by time, which give losses,
    the curve and the times; then the Brier sums along with the counts by (t, risk) that concordance is ranked from."""
    spark, times = rows.sparkSession, by_time(rows)
    names = ["c_index", "ibs", "nll", "ranking", "combined"]
    c_index, scores = 0.5, _brier_rows(spark, {})
    if times:
        n_bins, last = max(r.bins for r in times), times[-1].t
        parts = _weighted_losses(times, cause, n_bins)
        risk = F.round(own_time_risk(F.col("pmf"), cause, F.lit(min(last, n_bins - 1))), 12)
        case = ((F.col("e") == cause) & (F.col("t") < last)).cast("long")
        scored = rows.filter("t is not null").select("t", case.alias("case"), risk.alias("risk"), *(loss.alias(f"l{tau}") for tau, loss in parts))
        counts = written(scored.groupBy("t", "risk").agg(F.count("*").alias("members"), F.sum("case").alias("cases"), *(f(f"l{tau}").alias(f"{n}{tau}") for tau, _ in parts for n, f in (("n", F.count), ("s", F.sum)))))
        found = counts.agg(*(F.sum(f"{n}{tau}").alias(f"{n}{tau}") for tau, _ in parts for n in "ns")).first()
        scores = _brier_rows(spark, {tau: (found[f"n{tau}"], found[f"s{tau}"]) for tau, _ in parts})
        pairs, good = rank_counts(counts.filter("risk is not null").select("t", "risk", "members", "cases"))
        c_index = good / pairs if pairs else 0.5
    nll, ranking, combined, _ = _losses(times)
    out = integrated(scores).select(F.lit(c_index).alias("c_index"), "ibs", *(F.lit(v).cast("double").alias(n) for n, v in (("nll", nll), ("ranking", ranking), ("combined", combined))))
    return out.select(*(F.round(n, 4).alias(n) for n in names)).withColumn("report", F.to_json(F.struct(*names)))
