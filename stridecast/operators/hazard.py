"""A discrete-time competing-risk model: hazards of each cause that are proportional to a baseline by bin, fitted by Newton steps on sums
over risk sets, and predicted probabilities for each bin."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridecast.functions.curves import sum_of
from stridecast.operators.metrics import rank_counts
from stridecast.operators.prep import fit_scaler, scale
from stridecast.sources.shared import written


def person_periods(rows: DataFrame, features: list[str], bins: int, causes: int) -> DataFrame:
    """A row for each bin that a subject was at risk in: y is the cause where the event happened, else 0."""
    last = F.least(F.col("t"), F.lit(bins - 1))
    long = rows.select("e", "t", *features, F.explode(F.sequence(F.lit(0), last)).alias("b"))
    y = F.when((F.col("b") == F.col("t")) & (F.col("e").between(1, causes)), F.col("e")).otherwise(0)
    return long.select(*features, "b", y.cast("double").alias("y"))


@dataclass
class HazardModel:
    """Of each cause: weights of the scaled features and a baseline for each bin. A cause's hazard in a bin is its baseline times
    exp(weights . features); one that never occurs has none. steps: log-likelihood and weights of each evaluation."""

    features: list[str]
    scaler: dict
    bins: int
    causes: int
    weights: list[list[float]]
    baseline: list[list[float]]
    steps: list[tuple[float, list[list[float]]]] = field(default_factory=list)

    def scores(self) -> Column:
        """exp(weights . features) of each cause."""
        unit = F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, (m, s) in ((c, self.scaler[c]) for c in self.features)))
        product = lambda w: F.exp(F.aggregate(F.zip_with(unit, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
        return F.transform(F.lit([[float(x) for x in w] for w in self.weights]), product)

    def pmf(self) -> Column:
        """The probability of each cause in each bin: what is left before the bin, times the chance of any event in it, times the
        cause's share of its hazard."""
        base = F.lit([[float(x) for x in row] for row in self.baseline])
        before = F.lit([[float(x) for x in np.concatenate([[0.0], np.cumsum(row)[:-1]])] for row in self.baseline])
        at = lambda table, score, i: F.aggregate(F.zip_with(table, score, lambda row, x: F.get(row, i) * x), F.lit(0.0), lambda a, x: a + x)

        def of_bin(score: Column, i: Column) -> Column:
            whole = at(base, score, i)
            return F.when(whole > 0, F.exp(-at(before, score, i)) * (1 - F.exp(-whole)) / whole).otherwise(0.0)

        def rows(score: Column) -> Column:
            chance = F.transform(F.sequence(F.lit(0), F.lit(self.bins - 1)), lambda i: of_bin(score, i))
            return F.get(F.transform(F.array(chance), lambda p: F.zip_with(base, score, lambda row, x: F.zip_with(p, row, lambda q, b: q * b * x))), F.lit(0))

        # lambdas hold the scores, so that they aren't computed again for each bin
        return F.get(F.transform(F.array(self.scores()), rows), F.lit(0))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("pmf", self.pmf())


def _at_risk(data: DataFrame, weights: np.ndarray, bins: int) -> np.ndarray:
    """Sums over the rows at risk in each bin, [fit, cause, bin, 1 + d + d * (d + 1) / 2], of exp(weights . x) times 1, x and the products
    of two of x. A row adds to the bin it leaves in, and sums from the last bin back give the risk sets; so a row is
    worked on once, whatever the number of bins. All fits share one scan."""
    fits, causes, d = weights.shape
    low, high = np.triu_indices(d)
    width = 1 + d + len(low)
    sent = data.sparkSession.sparkContext.broadcast(weights.reshape(-1, d))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((fits * causes, bins, width))
        step = max(1, 4_000_000 // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, last = np.asarray(part.column(0).flatten(), float).reshape(-1, d), np.asarray(part.column(1))
                order = np.argsort(last, kind="stable")
                x = x[order]
                there, first = np.unique(last[order], return_index=True)
                terms = np.hstack([np.ones((len(x), 1)), x, x[:, low] * x[:, high]])
                for k, score in enumerate(np.exp(x @ sent.value.T).T):
                    total[k, there] += np.add.reduceat(terms * score[:, None], first, axis=0)
        some = np.flatnonzero(total.any(axis=(0, 2)))
        fit, bin_, at = (i.ravel() for i in np.meshgrid(np.arange(fits * causes), some, np.arange(width), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(bin_, pa.int32()), pa.array(at, pa.int32()), pa.array(total[fit, bin_, at])], ["fit", "bin", "at", "total"])

    found = np.zeros((fits * causes, bins, width))
    for r in data.select("x", "last").mapInArrow(run, "fit int, bin int, at int, total double").groupBy("fit", "bin", "at").agg(F.sum("total").alias("total")).collect():
        found[r.fit, r.bin, r["at"]] = r.total
    return found[:, ::-1].cumsum(axis=1)[:, ::-1].reshape(fits, causes, bins, width)


def fit_grid(rows: DataFrame, features: list[str], bins: int = 60, causes: int = 2, grid: tuple[float, ...] = (1e-3,), iterations: int = 30, tolerance: float = 1e-9) -> list[HazardModel]:
    """A model for each regularisation of the grid, fitted on (t, e, features); null features count as their mean, rows without t go, and
    events after the last bin leave in it without one.

    The likelihood is that of events within their risk sets (ties counted alike), less regularisation * rows / 2 * the weights' square.
    Each Newton step of all fits together is one scan of the rows, which are written once as arrays; only sums by bin reach the
    driver. A fit is done once its Newton decrement, which bounds what is left to gain, is below tolerance * rows; a step
    that loses is halved.
    """
    scaler = fit_scaler(rows, features)
    filled = scale(rows, scaler).na.fill(0.0, features).filter("t is not null")
    happened = (F.col("t") < bins) & F.col("e").between(1, causes)
    data = written(filled.select(F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.greatest(F.least(F.col("t"), F.lit(bins - 1)), F.lit(0)).cast("int").alias("last"), F.when(happened, F.col("e")).otherwise(0).cast("int").alias("y")))
    d = len(features)
    deaths, seen, n = np.zeros((causes, bins)), np.zeros((causes, d)), 0
    for r in data.groupBy("y", "last").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("x", F.lit(i))) for i in range(d))).alias("s")).collect():
        n += r.n
        if r.y:
            deaths[r.y - 1, r.last] = r.n
            seen[r.y - 1] += r.s
    low, high = np.triu_indices(d)
    fits = [{"w": np.zeros((causes, d)), "best": -math.inf, "steps": [], "g": g} for g in grid]
    todo = fits if n else []
    for turn in range(iterations):
        if not todo:
            break
        sums = _at_risk(data, np.stack([f["w"] for f in todo]), bins)
        left = []
        for f, risk in zip(todo, sums):
            value, move, decrement = 0.0, np.zeros((causes, d)), 0.0
            for c in range(causes):
                on = deaths[c] > 0
                k, s = deaths[c][on], risk[c][on]
                mean = s[:, 1 : d + 1] / s[:, :1]
                second = np.zeros((len(k), d, d))
                second[:, low, high] = second[:, high, low] = s[:, d + 1 :] / s[:, :1]
                value += seen[c] @ f["w"][c] - k @ np.log(s[:, 0]) - f["g"] * n / 2 * f["w"][c] @ f["w"][c]
                gradient = seen[c] - k @ mean - f["g"] * n * f["w"][c]
                curve = np.einsum("b,bij->ij", k, second - mean[:, :, None] * mean[:, None, :]) + f["g"] * n * np.eye(d)
                move[c] = np.linalg.lstsq(curve, gradient, rcond=None)[0]
                decrement += gradient @ move[c]
            if value < f["best"] - 1e-9 * abs(f["best"]):
                f["w"] = (f["w"] + f["from"]) / 2
                left.append(f)
                continue
            f["steps"].append((float(value), f["w"].tolist()))
            f["best"], f["from"] = value, f["w"]
            f["baseline"] = np.divide(deaths, risk[:, :, 0], out=np.zeros((causes, bins)), where=risk[:, :, 0] > 0)
            if decrement / 2 > tolerance * n and turn < iterations - 1:
                f["w"] = f["w"] + move
                left.append(f)
        todo = left
    return [HazardModel(features, scaler, bins, causes, f.get("from", f["w"]).tolist(), f.get("baseline", np.zeros((causes, bins))).tolist(), f["steps"]) for f in fits]


def fit_hazards(rows: DataFrame, features: list[str], bins: int = 60, causes: int = 2, regularisation: float = 1e-3, iterations: int = 30) -> HazardModel:
    """One model; see fit_grid."""
    return fit_grid(rows, features, bins, causes, (regularisation,), iterations)[0]


def sweep(train: DataFrame, val: DataFrame, features: list[str], grid: list[float], bins: int = 60, causes: int = 2, cause: int = 1) -> tuple[float, list[dict], HazardModel]:
    """The regularisation whose model has the best concordance on val, the first of equals. All points are fitted together (fit_grid) and
    scored in one scan of val; from its counts by point, time and risk each point is ranked by itself."""
    models = fit_grid(train, features, bins, causes, tuple(grid))
    last = val.agg(F.max("t").alias("m")).first()["m"]
    risks = F.array(*(F.round(sum_of(F.slice(F.get(m.pmf(), F.lit(cause - 1)), 1, min(last, bins - 1) + 1)), 12) for m in models)) if last is not None else None
    tried = []
    if risks is not None:
        case = ((F.col("e") == cause) & (F.col("t") < last)).cast("long")
        scored = val.filter("t is not null").select("t", case.alias("case"), F.posexplode(risks).alias("point", "risk"))
        counts = written(scored.groupBy("point", "t", "risk").agg(F.count("*").alias("members"), F.sum("case").alias("cases")))
    for i, g in enumerate(grid):
        pairs, good = rank_counts(counts.filter(F.col("point") == i).drop("point")) if risks is not None else (0, 0.0)
        tried.append({"regularisation": g, "c_index": good / pairs if pairs else 0.5})
    best = max(range(len(grid)), key=lambda i: (tried[i]["c_index"], -i))
    return grid[best], tried, models[best]
