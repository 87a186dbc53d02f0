"""Filters with a meaning of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def primary_events(events: DataFrame, severity: str, primary: str = "rupture") -> DataFrame:
    """Events of the primary severity only."""
    return events.filter(F.col(severity) == primary)


def active_since(entities: DataFrame, last_year: str, first_wanted: int) -> DataFrame:
    """Entities whose last year is the first one wanted or later, or isn't known."""
    return entities.filter(F.col(last_year).isNull() | (F.col(last_year) >= first_wanted))


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the label or time columns."""
    return rows.dropna(subset=list(columns))


def decided(rows: DataFrame, label: str) -> DataFrame:
    """Rows whose label isn't an abstention (below 0) or null."""
    return rows.filter(F.col(label) >= 0)


def known_by(rows: DataFrame, day: str, observed: str | Column) -> DataFrame:
    """Rows of the observation's day or before: nothing from its future."""
    return rows.filter(F.col(day) <= (F.col(observed) if isinstance(observed, str) else observed))
