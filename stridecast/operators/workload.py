"""Load over time: exponentially weighted means on a gap-filled calendar, ratios, spikes, rolling sums, recency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridecast.operators.scan import with_earlier_rows

#: The acute and chronic days of each scale.
SCALES = {"3_21": (3, 21), "7_28": (7, 28), "14_56": (14, 56)}
FLOOR = 1e-3


def daily(rows: DataFrame, entity: str, day: str, load: str) -> DataFrame:
    """One row an entity and day, loads summed; rows without an entity or a day go."""
    keyed = rows.filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return keyed.groupBy(entity, F.col(day).cast("date").alias(day)).agg(F.sum(load).cast("double").alias(load))


def fill_gaps(rows: DataFrame, entity: str, day: str, load: str) -> DataFrame:
    """A row for each day between an entity's first and last, loads of missing days 0, other columns as in its
    first row; _gap_fill marks the new rows. rows: one row an entity and day."""
    others = [c for c in rows.columns if c not in (entity, day, load)]
    span = rows.groupBy(entity).agg(F.min(day).alias("_first"), F.max(day).alias("_last"), *(F.min_by(c, day).alias(f"_{c}") for c in others))
    calendar = span.select(entity, F.explode(F.sequence("_first", "_last")).alias(day), *(f"_{c}" for c in others))
    joined = calendar.join(rows.withColumn("_real", F.lit(True)), [entity, day], "left")
    filled = [F.when(F.col("_real"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in others]
    return joined.select(entity, day, F.coalesce(load, F.lit(0.0)).alias(load), *filled, F.col("_real").isNull().alias("_gap_fill"))


def load_ratios(rows: DataFrame, keys: list[str], day: str, load: str, scales: dict[str, tuple[int, int]] = SCALES, calendar: bool = True) -> DataFrame:
    """rows with ewma_acute_S, ewma_chronic_S and acwr_S for each scale S; null where the chronic mean is below the floor.

    A mean is the adjusted exponentially weighted mean of span 2 * days - 1, days without a row weighing as zeros: weights are
    (1 - 1 / days) to the age. rows: one row a key and day. Without calendar, ages count rows and not days. Zeros add nothing to
    the weighted sum, and the weights of all days so far are a geometric series, so no row is made for a gap. Running sums are
    kept in blocks of so many days that rescaled weights stay finite; of earlier blocks as many count as can matter (down
    to 1e-40 of a load). All means share one partitioning by the keys. With a calendar blocks are of fixed days, so that all share
    one sort by block and day, too, made of the rows as they come: a task holds them once.
    """
    days = sorted({d for pair in scales.values() for d in pair if d > 1})
    digits = {d: -math.log10(1 - 1 / d) for d in days}  # that a day's weight loses
    length = int(250 / max(digits.values(), default=1))
    place = (F.col("_at") - F.col("_block") * length).cast("double")
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) if calendar else F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1
    out = rows.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / length).cast("int"))
    # the first window deals by the keys, and its sort serves those that follow
    along = Window.partitionBy(*keys).orderBy("_block", "_at")
    out = out.withColumn("_index", F.col("_at") - F.first("_at").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.select("*", *((F.col(load) * F.pow(F.lit(1 - 1 / d), -place)).alias(f"_scaled_{d}") for d in days))
    within = Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    out = out.select("*", *(F.sum(f"_scaled_{d}").over(within).alias(f"_own_{d}") for d in days))
    earlier = {d: range(1, 1 + math.ceil(40 / (digits[d] * length))) for d in days}
    by_block = Window.partitionBy(*keys).orderBy("_block")
    out = out.select("*", *(F.sum(f"_scaled_{d}").over(by_block.rangeBetween(-b, -b)).alias(f"_before_{d}_{b}") for d in days for b in earlier[d]))

    def mean(d: int) -> Column:
        if d == 1:
            return F.col(load).cast("double")
        w = F.lit(1 - 1 / d)
        total = sum((F.coalesce(f"_before_{d}_{b}", F.lit(0.0)) * F.pow(w, place + b * length) for b in earlier[d]), F.col(f"_own_{d}") * F.pow(w, place))
        return total * (1 - w) / (1 - F.pow(w, F.col("_index") + 1))

    means = out.select(*rows.columns, *(mean(d).alias(f"ewma_{n}_{s}") for s, pair in scales.items() for n, d in zip(("acute", "chronic"), pair)))
    return means.withColumns({f"acwr_{s}": F.when(F.col(f"ewma_chronic_{s}") >= FLOOR, F.col(f"ewma_acute_{s}") / F.col(f"ewma_chronic_{s}")) for s in scales})


def add_spikes(rows: DataFrame, threshold: float = 1.5, scales: dict[str, tuple[int, int]] = SCALES) -> DataFrame:
    """spike_S for each scale and spike_any: whether the ratio is over the threshold; a null ratio is no spike."""
    flags = {f"spike_{s}": F.coalesce(F.col(f"acwr_{s}") > threshold, F.lit(False)) for s in scales}
    return rows.withColumns(flags).withColumn("spike_any", F.greatest(*(F.col(f) for f in flags)) if len(flags) > 1 else F.col(next(iter(flags))))


def rolling(rows: DataFrame, keys: list[str], day: str, load: str, windows: tuple[int, ...] = (7, 14, 30, 60), by_day: bool = False, most: int | None = None) -> DataFrame:
    """load_sum_W and load_mean_W over the last W rows (by_day: the last W days, or units of a number).

    A key's rows are one sorted run: at most a row a day after daily(). Where rows are finer, keys of more than `most` rows are cut in
    ranges that take along the earlier rows that their frames reach (scan.with_earlier_rows).
    """
    place = F.unix_date(F.col(day)) if by_day and isinstance(rows.schema[day].dataType, T.DateType) else F.col(day)
    out, parts = rows, keys
    if most is not None:
        out = with_earlier_rows(rows.withColumn("_place", place), keys, "_place", max(windows), most, by_day)
        place, parts = F.col("_place"), [*keys, "_range"]
    base = Window.partitionBy(*parts).orderBy(place)
    for n in windows:
        frame = base.rangeBetween(-(n - 1), 0) if by_day else base.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"load_sum_{n}", F.sum(load).over(frame)).withColumn(f"load_mean_{n}", F.avg(load).over(frame))
    return out if most is None else out.filter("not _copy").drop("_copy", "_hot", "_range", "_place")


def recency(observed: DataFrame, events: DataFrame, keys: list[str], at: str, day: str) -> DataFrame:
    """keys, at, days_since_last, events_last_7, events_last_14 of each observed row: days since the key's last event on or
    before it (null without one), and events in the closed weeks before it. events: one row a key and day.

    Both sides are dealt once by the keys and merged in one order: no observation meets an event as a pair.
    """
    left = observed.select(*keys, F.col(at).alias("_d"), F.lit(None).cast("date").alias("_day"))
    right = events.filter(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_d"), F.col(day).alias("_day"))
    order = Window.partitionBy(*keys).orderBy(F.unix_date("_d"))
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    count = lambda n: F.count("_day").over(order.rangeBetween(-n, 0))
    both = left.withColumn("_asks", F.lit(True)).unionByName(right.withColumn("_asks", F.lit(False)))
    seen = both.select(*keys, "_d", "_asks", F.max("_day").over(upto).alias("_last"), count(7).alias("events_last_7"), count(14).alias("events_last_14"))
    return seen.filter("_asks").select(*keys, F.col("_d").alias(at), F.datediff("_d", "_last").alias("days_since_last"), "events_last_7", "events_last_14")
