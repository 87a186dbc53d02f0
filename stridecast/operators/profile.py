"""Summaries: counts, describe, histograms, comparisons, percentiles, top values, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_summary(events: DataFrame, day: str, label: str) -> DataFrame:
    """label, n, first_day, last_day; the row of a null label and total_rows true is of all events."""
    each = events.groupBy(label).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("total_rows", F.lit(False))
    whole = each.agg(F.sum("n").alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).withColumn("total_rows", F.lit(True))
    return each.unionByName(whole, allowMissingColumns=True)


def per_year(events: DataFrame, day: str) -> DataFrame:
    return events.filter(F.col(day).isNotNull()).groupBy(F.year(day).alias("year")).agg(F.count("*").alias("n"))


def quantiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """feature, i (of the share), value, n: exact quantiles of (feature, value) with linear interpolation; nulls left out.

    A sketch gives each feature bounds around each share; one pass counts the values below the lower bound, and the few between the
    bounds are ranked: about one in 1,500, so no task holds a column. The sketch is off by one in 10,000 ranks at most, a
    third of what the bounds leave. A feature of few values is ranked whole. Bounds and counts are a row a feature and share.
    """
    values = values.filter(F.col("value").isNotNull())
    room, few = 3e-4, 20_000
    sides = [min(1.0, max(0.0, s + d)) for s in shares for d in (-room, room)]
    bounds = values.groupBy("feature").agg(F.percentile_approx("value", sides, 10_000).alias("b"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    small = F.col("n") < few
    bounds = bounds.withColumn("b", F.transform("b", lambda x, i: F.when(small, F.when(i % 2 == 0, F.col("least")).otherwise(F.col("most"))).otherwise(x)))
    place = F.array(*(F.struct(F.lit(i).alias("i"), F.get("b", F.lit(2 * i)).alias("low"), F.get("b", F.lit(2 * i + 1)).alias("high"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares)))
    bounds = F.broadcast(bounds.select("feature", "n", F.inline(place)))
    met = values.join(bounds, "feature").filter(F.col("value") <= F.col("high"))
    keys = ["feature", "i", "n", "at"]
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    # everything below the bounds is one row, of a null value, which sorts first
    counts = met.groupBy(*keys, inside.alias("v")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).filter(F.col("v").isNotNull())
    pick = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    found = ranked.groupBy(*keys).agg(pick(F.floor("at")).alias("a"), pick(F.ceil("at")).alias("b"))
    return found.select("feature", "i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"), "n")


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n, mean, sd, least, q1, median, q3, greatest; exact (see quantiles), over stacked columns."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("s")).select("s.*").filter(F.col("value").isNotNull())
    out = stacked.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    wide = quantiles(stacked, [0.25, 0.5, 0.75]).groupBy("feature").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    return out.join(wide, "feature").select("feature", "n", "mean", "sd", "least", "q1", "median", "q3", "greatest")


def histogram(rows: DataFrame, column: str, bins: int = 50, threshold: float | None = None) -> DataFrame:
    """bin, low, high, n over equal bins of [min, max], the last one closed; share_over of the threshold on each row."""
    x = F.col(column).cast("double")
    over = F.avg(F.when(x > threshold, 1.0).otherwise(0.0)) if threshold is not None else F.lit(None).cast("double")
    found = rows.filter(x.isNotNull()).agg(F.min(x).alias("a"), F.max(x).alias("b"), over.alias("s")).first()
    if found["a"] is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n long, share_over double")
    low, high = found["a"], found["b"] if found["b"] > found["a"] else found["a"] + 1
    width = (high - low) / bins
    place = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return rows.filter(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n", F.lit(found["s"]).cast("double").alias("share_over"))


def compare_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and sample deviation of a value by group, nulls left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def split_counts(rows: DataFrame, split: str, entity: str, event: Column) -> DataFrame:
    return rows.groupBy(split).agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"), F.sum(F.when(event, 1).otherwise(0)).alias("n_events"))


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, value: exact, with linear interpolation (see quantiles)."""
    found = quantiles(rows.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("value")), shares)
    return found.select(F.get(F.array(*(F.lit(s) for s in shares)), F.col("i")).alias("share"), "value")


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def importance(attributions: DataFrame, feature: str, value: str, categories: dict[str, str] | None = None) -> DataFrame:
    """Mean absolute value by feature, or by category of the features."""
    name = F.col(feature)
    if categories is not None:
        name = reduce(lambda out, x: F.when(F.col(feature) == x[0], x[1]).otherwise(out), categories.items(), F.lit("other"))
    return attributions.groupBy(name.alias(feature if categories is None else "category")).agg(F.avg(F.abs(value)).alias("mean_abs"))


def union_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name, columns that one lacks null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def sorted_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """In order of the keys, nulls last; for output only."""
    return rows.orderBy(*(F.asc_nulls_last(k) for k in keys))


def first_rows(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by the keys, for trial runs."""
    return sorted_rows(rows, *keys).limit(n)
