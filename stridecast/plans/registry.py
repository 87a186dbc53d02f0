"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a function of (spark, sf_dir) under its name, with SQL that returns the same rows if there is any.

    The columns in dates are returned as ISO text by both, so that they compare alike whatever reads them.
    """

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates}) if dates else f(spark, sf_dir)
        if sql:
            text = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates)
            SQL[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql}) AS q" if dates else sql
        return f

    return add
