"""Scans along the order of a key whose hot keys are cut in ranges: each range is scanned by itself, and what crosses an edge is carried
by a small table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridecast.sources.shared import written

#: Ranges that a hot key is cut into.
PIECES = 256


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with right's other columns; null keys are equal. right has a row a hot key or range of one, at most PIECES for each `most`
    rows of left, and is broadcast for that."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(F.broadcast(named), on, how).drop(*(f"_right_{k}" for k in keys))


def in_ranges(rows: DataFrame, keys: list[str], order: str, most: int, pieces: int = PIECES) -> DataFrame:
    """rows with _range: 0 for keys of at most `most` rows, else the number of the range of `order` values (about equal numbers of
    rows each; rows of one value stay together), and _hot. Three passes over the keys and the order's column. The cuts come from a sketch,
    which depends on the order in which its parts arrive, so they are written: all that is made from the ranges must see the same."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n")
    theirs = joined(rows.select(*keys, order), hot, keys, "left_semi") if keys else rows
    cuts = written(theirs.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 100 * pieces)).alias("_cuts")))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return joined(rows, cuts, keys).withColumns({"_hot": F.col("_cuts").isNotNull(), "_range": F.when(F.col("_cuts").isNotNull() & F.col(order).isNotNull(), place).otherwise(0)}).drop("_cuts")


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, most: int | None = None, pieces: int = PIECES) -> DataFrame:
    """rows with `name`: the last value that isn't null up to each row, in the order of a key's rows (unique; a null order comes first).

    A key's rows are one sorted run of one task; those of keys with more than `most` rows are scanned by ranges, and each range's
    last value is carried into the later ones.
    """
    if most is None:
        over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(over))
    cut = in_ranges(rows.withColumn("_value", value), keys, order, most, pieces)
    over = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(F.col(order).isNotNull(), F.col(order))
    last = cut.filter("_hot").groupBy(*keys, "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), position)).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*keys, "_range", before.alias("_carried"))
    found = joined(cut.withColumn("_found", F.last("_value", ignorenulls=True).over(over)), carried, [*keys, "_range"])
    return found.withColumn(name, F.coalesce("_found", "_carried")).drop("_value", "_found", "_carried", "_hot", "_range")


def with_earlier_rows(rows: DataFrame, keys: list[str], order: str, width: int, most: int, by_value: bool = False, pieces: int = PIECES) -> DataFrame:
    """rows in ranges (in_ranges), each range of a hot key with copies (_copy) of the earlier rows that a frame of `width` rows, or of
    `width` values of the order, may reach from it. What a window over (keys, _range) gives to the rows that aren't copies is
    what one over the keys gives."""
    cut = in_ranges(rows, keys, order, most, pieces).withColumn("_copy", F.lit(False))
    hot = cut.filter(F.col("_hot") & F.col(order).isNotNull())
    edges = hot.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    edges = edges.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")))
    later = edges.select(*keys, F.col("_range").alias("_to"), (F.col("_upto") - F.col("_n")).alias("_before"), F.col("_low").alias("_from"))
    pairs = joined(edges, later, keys, "inner").filter("_range < _to")
    if by_value:
        reach = pairs.filter(F.col("_high") > F.col("_from") - width).select(*keys, "_range", "_to", "_from")
        sent = joined(hot, reach, [*keys, "_range"], "inner").filter(F.col(order) > F.col("_from") - width).drop("_from")
    else:
        reach = pairs.withColumn("_need", width - 1 - (F.col("_before") - F.col("_upto"))).filter("_need > 0").select(*keys, "_range", "_to", "_need")
        from_end = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.desc(order)))
        ends = hot.withColumn("_r", from_end).filter(F.col("_r") < width)
        sent = joined(ends, reach, [*keys, "_range"], "inner").filter("_r <= _need").drop("_r", "_need")
    sent = sent.withColumns({"_range": F.col("_to"), "_copy": F.lit(True)}).drop("_to")
    return cut.unionByName(sent)
