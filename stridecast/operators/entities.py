"""Entities: first and last records, key dedupe, new rows, and the resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridecast.sources.shared import written


def first_values(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first non-null value of each column of an entity, column by column; order must not tie."""
    others = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in others))


def first_row(rows: DataFrame, key: str, order: Column, last: bool = False) -> DataFrame:
    """The first (or last) whole row of an entity, its nulls kept; order must not tie."""
    others = [c for c in rows.columns if c != key]
    pick = F.max_by if last else F.min_by
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def dedupe_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def new_rows(batch: DataFrame, stored: DataFrame, name: str, day: str) -> DataFrame:
    """Rows of the batch whose (name, day) isn't stored yet, one a key within the batch too."""
    keyed = lambda df: df.withColumn("_name", name_key(F.col(name))).withColumn("_day", F.col(day).cast("date"))
    others = sorted(batch.columns)
    once = dedupe_first(keyed(batch), ["_name", "_day"], [F.col(c) for c in others])
    return once.join(keyed(stored).select("_name", "_day"), ["_name", "_day"], "left_anti").select(*batch.columns)


def without(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference by key; rows stay as often as they are."""
    return rows.join(excluded.select(*keys), keys, "left_anti")


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def containing(inner: DataFrame, outer: DataFrame, n: int = 3, by: list[str] = []) -> DataFrame:
    """Pairs of rows of inner (_in, ...) and outer (_out, ...) such that _out contains _in, and the columns `by` are equal;
    the other columns must differ. Empty texts are in none.

    Outer texts are posted under their n-character parts (and `by`). An inner text is looked up under its part that is posted
    least often, so a common part doesn't decide the work; a text shorter than n under itself, among the parts as short.
    No text is compared with all.
    """
    posts = outer.filter(F.length("_out") >= n).withColumn("_gram", F.explode(_grams(F.col("_out"), n)))
    counts = posts.groupBy(*by, "_gram").agg(F.count("*").alias("_count"))
    asked = inner.filter(F.length("_in") >= n).select(*by, "_in").distinct().withColumn("_gram", F.explode(_grams(F.col("_in"), n))).join(counts, [*by, "_gram"], "left")
    rarest = asked.groupBy(*by, "_in").agg(F.min_by("_gram", F.struct(F.coalesce("_count", F.lit(0)), "_gram")).alias("_gram"))
    found = inner.join(rarest, [*by, "_in"]).join(posts, [*by, "_gram"]).filter(F.contains("_out", F.col("_in"))).drop("_gram")
    none = F.array().cast("array<string>")
    parts = F.flatten(F.array(*(F.when(F.length("_out") >= k, _grams(F.col("_out"), k)).otherwise(none) for k in range(1, n))))
    short = inner.filter(F.length("_in").between(1, n - 1)).withColumn("_gram", F.col("_in"))
    return found.unionByName(short.join(outer.withColumn("_gram", F.explode(parts)), [*by, "_gram"]).drop("_gram"))


#: Directory names up to so many characters are posted under all their parts of the lengths asked; longer ones are looked up by containing().
LONGEST = 64


def parts_of(c: str, lengths: list[int]) -> Column:
    """The distinct parts of a text that have one of the lengths."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.when(F.length(c) >= n, _grams(F.col(c), n)).otherwise(none) for n in lengths))))


def resolve_names(names: DataFrame, directory: DataFrame, name: str, key: str, full_name: str, rank: str) -> DataFrame:
    """name, key, tier of each distinct name: 1 equal when lower-cased; 2 one contains the other, the first by rank;
    3 the only entry with the last name in it and the same first letter; else null and 0.

    The first tier is an equi-join. The later tiers take only the names left over. Entries are posted under their parts of the lengths that
    are asked for, each with how many entries have it and the first by rank; so a name meets one row, however common it is,
    and no pair of names is made. An entry within a name is looked up by its rarest three characters (see containing), and so are
    names within entries of more than LONGEST characters. Names, entries and names left over are written once.
    """
    asked = written(names.select(F.col(name)).filter(F.col(name).isNotNull()).distinct().withColumn("_k", name_key(F.col(name))))
    known = directory.filter(F.col(full_name).isNotNull()).select(F.col(key), F.col(rank).alias("_rank"), name_key(F.col(full_name)).alias("_full"))
    full = written(known.filter(F.col("_full") != "").select(F.col("_full").alias("_out"), F.struct("_rank", key).alias("_hit"), F.substring("_full", 1, 1).alias("_first")))
    exact = asked.join(full.groupBy(F.col("_out").alias("_k")).agg(F.min("_hit").alias("_hit")), "_k", "left").withColumn("_tier", F.when(F.col("_hit").isNotNull(), 1))
    exact = written(exact.select(name, "_k", "_tier", "_hit"))
    rest = exact.filter("_tier is null and _k != ''").select(name, "_k", F.element_at(F.split("_k", r"\s+"), -1).alias("_last"), F.substring("_k", 1, 1).alias("_first"))
    lengths = sorted(r.n for r in rest.select(F.explode(F.array(F.length("_k"), F.length("_last"))).alias("n")).filter(F.col("n").between(1, LONGEST)).distinct().collect())
    listed = full.filter(F.length("_out") <= LONGEST).select("_hit", "_first", F.explode(parts_of("_out", lengths)).alias("_part")) if lengths else full.limit(0).withColumn("_part", F.lit(""))
    posted = listed.groupBy("_part", "_first").agg(F.count("*").alias("_n"), F.min("_hit").alias("_hit"))
    within = rest.join(posted.groupBy("_part").agg(F.min("_hit").alias("_hit")), F.col("_k") == F.col("_part")).select(name, F.lit(2).alias("_tier"), "_hit")
    alike = rest.join(posted.withColumnRenamed("_first", "_letter"), (F.col("_last") == F.col("_part")) & (F.col("_first") == F.col("_letter"))).select(name, "_n", "_hit")
    longer = full.filter(F.length("_out") > LONGEST)
    if not longer.isEmpty():
        within = within.union(containing(rest.select(name, F.col("_k").alias("_in")), longer.select("_out", "_hit")).select(name, F.lit(2), "_hit"))
        alike = alike.union(containing(rest.select(name, F.col("_last").alias("_in"), "_first"), longer, by=["_first"]).select(name, F.lit(1).cast("long"), "_hit"))
    around = containing(full.select(F.col("_out").alias("_in"), "_hit"), rest.select(name, F.col("_k").alias("_out"))).select(name, F.lit(2).alias("_tier"), "_hit")
    alone = alike.groupBy(name).agg(F.sum("_n").alias("_n"), F.min("_hit").alias("_hit")).filter("_n = 1").select(name, F.lit(3).alias("_tier"), "_hit")
    best = exact.filter("_tier = 1").select(name, "_tier", "_hit").union(within).union(around).union(alone).groupBy(name).agg(F.min(F.struct("_tier", "_hit")).alias("_best"))
    return asked.select(name).join(best, name, "left").select(name, F.col("_best._hit")[key].alias(key), F.coalesce(F.col("_best._tier"), F.lit(0)).alias("tier"))
