"""Case-control cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def _drawn(seed: int, c: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string")))


def match_controls(cases: DataFrame, candidates: DataFrame, strata: list[str], case: str, candidate: str, per_case: int = 3, seed: int = SEED) -> DataFrame:
    """case, strata, candidate, draw: for each case per_case candidates of its strata, or all where there are fewer.

    A stratum's candidates stand in an order drawn by a hash of the id; a case takes those that follow a place drawn by a hash
    of its own, around the end. A candidate may serve several cases. Candidates must not be cases (see entities.without).
    The draw is the same however the data is partitioned.

    No case meets the candidates that it doesn't take: candidates get their places from counts by the hash's first
    digits, so no task sorts a stratum; cases then join by stratum and place. Counts are one row a stratum and prefix.
    """
    pool = candidates.select(candidate, *strata).distinct().withColumn("_h", _drawn(seed, candidate)).withColumn("_p", F.substring("_h", 1, 3))
    counts = pool.groupBy(*strata, "_p").agg(F.count("*").alias("_k"))
    by = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_k").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*strata, "_p", before.alias("_before"), F.sum("_k").over(by).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*strata, "_p").orderBy("_h", candidate)) - 1
    placed = pool.withColumn("_place", within).join(counts.drop("_n"), [*strata, "_p"]).select(*strata, candidate, (F.col("_before") + F.col("_place")).alias("_place"))
    first = F.conv(F.substring(_drawn(seed, case), 1, 8), 16, 10).cast("long")
    asked = cases.select(case, *strata).distinct().join(counts.select(*strata, "_n").distinct(), strata)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_case), F.col("_n")).cast("int") - 1)).alias("_j"))
    asked = asked.select(case, *strata, (F.col("_j") + 1).alias("draw"), F.pmod(first + F.col("_j"), F.col("_n")).alias("_place"))
    return asked.join(placed, [*strata, "_place"]).drop("_place")


def match_tiers(cases: DataFrame, pairs: DataFrame, case: str, per_case: int = 3) -> DataFrame:
    """tier (full, partial, none), n_cases."""
    counts = cases.select(case).distinct().join(pairs.groupBy(case).agg(F.count("*").alias("_n")), case, "left")
    n = F.coalesce("_n", F.lit(0))
    tier = F.when(n >= per_case, "full").when(n > 0, "partial").otherwise("none")
    return counts.groupBy(tier.alias("tier")).agg(F.count("*").alias("n_cases"))


def unmatched(cases: DataFrame, controls: DataFrame, group: list[str]) -> DataFrame:
    """Cases of groups that have no control."""
    return cases.join(controls.select(*group).distinct(), group, "left_anti")
