"""Sampled Shapley attributions of a scorer."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridecast.sources.shared import written


def _orders(features: int, pairs: int, n: int, rng: random.Random, first: int = 0) -> list[tuple[int, int, int, list[int]]]:
    """(pair, way, background row, permutation): each drawn permutation and its reverse, background rows in turn."""
    out = []
    for p in range(first, first + pairs):
        order = list(range(features))
        rng.shuffle(order)
        out += [(p, 0, p % n, order), (p, 1, p % n, order[::-1])]
    return out


def _scored(rows: DataFrame, background: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame], orders: list) -> DataFrame:
    """key, pair and a column for each feature (_part): what a scored row adds to the feature, or takes from it, along a permutation; to be
    summed by key, or by key and pair. Rows are dealt out by the key before they are multiplied: a small file of them would be one task, and
    the sums need no further shuffle."""
    places = [(p, way, b, [order.index(i) for i in range(len(order))]) for p, way, b, order in orders]
    plan = rows.sparkSession.createDataFrame(places, "pair int, way int, b int, place array<int>")
    numbered = background.select(F.struct(*(F.col(f).cast("double").alias(f) for f in features)).alias("_back"), F.row_number().over(_order(features)).alias("_b"))
    drawn = F.broadcast(plan.join(numbered, F.col("b") == F.col("_b") - 1).select("pair", "place", "_back"))
    own = rows.select(key, F.struct(*(F.col(f).cast("double").alias(f) for f in features)).alias("_own"))
    own = own.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    steps = own.crossJoin(drawn).select(key, "pair", "place", "_own", "_back", F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("step"))
    place = lambda i: F.get("place", F.lit(i))
    mixed = steps.select(key, "pair", "place", "step", *(F.when(place(i) < F.col("step"), F.col("_own")[f]).otherwise(F.col("_back")[f]).alias(f) for i, f in enumerate(features)))
    # the difference of neighbouring steps: each score adds to one feature and takes from the next
    part = lambda i: F.when(place(i) == F.col("step") - 1, F.col("score")).when(place(i) == F.col("step"), -F.col("score"))
    return score(mixed).select(key, "pair", *(part(i).alias(_part(i)) for i in range(len(features))))


def _part(i: int, kind: str = "v") -> str:
    return f"_{kind}_{i}"


def _rows_of(background: DataFrame, most: int) -> int:
    n = background.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"the background must have 1 to {most} rows")
    return n


def shapley(rows: DataFrame, background: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame], samples: int = 16, seed: int = 42, most_background: int = 1000) -> DataFrame:
    """key, feature, phi: the mean over sampled permutations and background rows of what a feature adds to the score.

    score takes a DataFrame of the features and returns it with a column score. background is a sample of most_background rows at
    most (more raise an error), so what is broadcast is bounded. For each row, permutation and background row features are switched
    from the background's to the row's in the permutation's order. Each background row is used equally often, with each of its
    permutations and its reverse: samples is raised to a multiple of twice their number, so that the differences add up to
    score(row) - mean score(background). Work is rows x samples x (features + 1), scored in one job.
    """
    n = _rows_of(background, most_background)
    pairs = n * -(-samples // (2 * n))
    scored = _scored(rows, background, key, features, score, _orders(len(features), pairs, n, random.Random(seed)))
    summed = scored.groupBy(key).agg(*((F.sum(_part(i)) / (2 * pairs)).alias(_part(i)) for i in range(len(features))))
    return summed.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(_part(i)).alias("phi")) for i, f in enumerate(features)))))


def bounded_shapley(rows: DataFrame, background: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame], tolerance: float, rounds: int = 6, z: float = 1.959963984540054, seed: int = 42, most_background: int = 1000) -> DataFrame:
    """key, feature, phi, error, n_pairs: shapley by sequential sampling. error is the half-width of the normal interval (z) of phi.

    A round draws a permutation and its reverse for each background row, as many in the first round, twice as many in each later one. A
    pair's mean is one sample of a feature, of which number, sum and sum of squares are kept by row. A row leaves
    once the errors of all its features are within the tolerance, so later rounds score only the rows that need them; what is
    left after the last round keeps the error it has. Keys are unique. Each round's sums are written, so a lost executor
    costs a round at most.
    """
    n = _rows_of(background, most_background)
    rng, drawn, left, done = random.Random(seed), 0, rows, []
    state, numbers = None, range(len(features))
    for turn in range(rounds):
        pairs = n << turn
        scored = _scored(left, background, key, features, score, _orders(len(features), pairs, n, rng, drawn))
        drawn += pairs
        each = scored.groupBy(key, "pair").agg(*((F.sum(_part(i)) / 2).alias(_part(i)) for i in numbers))
        sums = each.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(_part(i)).alias(_part(i, "s")) for i in numbers), *(F.sum(F.col(_part(i)) * F.col(_part(i))).alias(_part(i, "ss")) for i in numbers))
        if state is not None:
            sums = sums.unionByName(state).groupBy(key).agg(*(F.sum(c).alias(c) for c in state.columns if c != key))
        sums = sums.select("*", *(_error(i, z).alias(_part(i, "error")) for i in numbers))
        widest = F.array_max(F.array(*(F.coalesce(_part(i, "error"), F.lit(float("inf"))) for i in numbers)))
        sums = written(sums.withColumn("_stays", widest > tolerance))
        last = turn == rounds - 1
        done.append(sums if last else sums.filter("not _stays"))
        if last or not (going := sums.filter("_stays")).take(1):
            break
        state = going.select(key, "n", *(_part(i, kind) for kind in ("s", "ss") for i in numbers))
        left = written(rows.select(key, *features).join(going.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_semi"))
    of = lambda i, f: F.struct(F.lit(f).alias("feature"), (F.col(_part(i, "s")) / F.col("n")).alias("phi"), F.col(_part(i, "error")).alias("error"))
    out = reduce(DataFrame.union, done)
    return out.select(key, F.inline(F.array(*(of(i, f) for i, f in enumerate(features)))), F.col("n").alias("n_pairs"))


def _error(i: int, z: float) -> Column:
    """The half-width of a feature's normal interval, from number, sum and sum of squares."""
    n, s, ss = F.col("n"), F.col(_part(i, "s")), F.col(_part(i, "ss"))
    spread = F.greatest(ss - s * s / n, F.lit(0.0)) / F.greatest(n - 1, F.lit(1))
    return F.when(n > 1, z * F.sqrt(spread / n))


def _order(features: list[str]):
    return Window.orderBy(*features)
