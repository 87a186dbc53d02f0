"""End-to-end feature matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridecast.functions.scalars import days_into_season
from stridecast.operators.cohort import match_controls
from stridecast.operators.entities import without
from stridecast.operators.pit import asof_join, observation_spine, ratio_snapshot, replace_columns, static_join
from stridecast.operators.profile import union_aligned


def panel_matrix(profiles: DataFrame, events: DataFrame, sources: dict[str, tuple[DataFrame, str]], entity: str, debut: str, event_day: str, study_end: str, static: list[str], interval: int = 30) -> DataFrame:
    """A spine with static attributes and, of each source, the last features on or before the date, under its prefix.

    sources: prefix -> (features keyed by entity, their date column).
    """
    spine = observation_spine(profiles, events, entity, debut, event_day, study_end, interval)
    out = static_join(spine, profiles.select(entity, *static), entity)
    for prefix, (features, day) in sources.items():
        out = asof_join(out, features, entity, "observation_date", day, prefix=f"{prefix}_")
    return out


def case_control_matrix(cases: DataFrame, roster: DataFrame, entity: str, day: str, strata: list[str], attributes: DataFrame, per_case: int = 3, same_day: bool = False) -> DataFrame:
    """entity, case_id, event, observation_date, time_elapsed_days, attributes: a row a case and one for each control drawn.

    Cases are observed on their event's day and controls on June 15 of the season, which lets recency tell them apart;
    same_day observes a control on its case's day instead.
    """
    pool = without(roster.withColumnRenamed(entity, "_c"), cases.select(F.col(entity).alias("_c")).distinct(), ["_c"])
    drawn = match_controls(cases.withColumnRenamed(entity, "_case"), pool, strata, "_case", "_c", per_case)
    june: Column = F.make_date(F.col("season"), F.lit(6), F.lit(15))
    own = cases.select(F.col(entity), F.col(entity).alias("case_id"), F.lit(1).alias("event"), F.col(day).alias("observation_date"))
    dates = cases.select(F.col(entity).alias("_case"), F.col(day).alias("_day"), "season")
    controls = drawn.select("_case", "_c").join(dates, "_case").select(F.col("_c").alias(entity), F.col("_case").alias("case_id"), F.lit(0).alias("event"), (F.col("_day") if same_day else june).alias("observation_date"))
    rows = union_aligned(own, controls)
    return static_join(rows.withColumn("time_elapsed_days", days_into_season(F.col("observation_date"))), attributes, entity)


def refresh_loads(matrix: DataFrame, loads: DataFrame, entity: str, observed: str, day: str, load: str, event: str) -> DataFrame:
    """The matrix with its load columns computed anew for each (entity, observation)."""
    keys = [entity, observed]
    once = matrix.groupBy(*keys).agg(F.max(event).alias(event))
    return replace_columns(matrix, ratio_snapshot(once, loads, entity, observed, day, load, event).drop(event), keys)
