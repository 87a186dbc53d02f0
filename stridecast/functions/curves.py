"""Arrays of predicted probabilities: pmf is array<array<double>>, a row of time bins for each cause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_sums(xs: Column, start: float = 0.0) -> Column:
    """start, start + x1, start + x1 + x2, ...: one longer than xs."""
    begin = F.array(F.lit(start))
    return F.aggregate(xs, begin, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def sum_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax_pmf(logits: Column, causes: int, bins: int) -> Column:
    """One softmax over all causes and bins of a flat array of logits."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    # lambdas hold the exponentials and their sum, so that neither is computed again for each element
    shares = F.get(F.transform(F.array(F.struct(exps.alias("e"), sum_of(exps).alias("s"))), lambda p: F.transform(p["e"], lambda x: x / p["s"])), F.lit(0))
    return F.get(F.transform(F.array(shares), lambda s: F.array(*(F.slice(s, c * bins + 1, bins) for c in range(causes)))), F.lit(0))


def over_causes(pmf: Column) -> Column:
    """The probability of any cause in each bin."""
    return F.aggregate(F.slice(pmf, 2, F.greatest(F.size(pmf) - 1, F.lit(0))), F.get(pmf, F.lit(0)), lambda a, row: F.zip_with(a, row, lambda x, y: x + y))


def survival(pmf: Column) -> Column:
    """1, then 1 less the probability of any cause so far."""
    return F.transform(prefix_sums(over_causes(pmf)), lambda x: 1 - x)


def incidence(pmf: Column, cause: int) -> Column:
    """0, then the cumulative incidence of a cause (from 1)."""
    return prefix_sums(F.get(pmf, F.lit(cause - 1)))


def horizon_risk(pmf: Column, cause: int, bins: int | Column) -> Column:
    """The probability of a cause in the first bins."""
    n = F.lit(bins) if isinstance(bins, int) else bins
    return sum_of(F.slice(F.get(pmf, F.lit(cause - 1)), F.lit(1), n))


def bins_within(days: int, n_bins: int = 60, horizon: int = 1825) -> int:
    return int(n_bins * days / horizon)
