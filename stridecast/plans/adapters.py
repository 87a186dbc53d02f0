"""The given tables in the parts of load logs, profiles, events, cohorts, predictions and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridecast.functions.curves import softmax_pmf
from stridecast.functions.scalars import season_year
from stridecast.operators.weaklabel import Rule
from stridecast.operators.workload import daily

STUDY_END = "2001-08-01"
CAUSES, BINS = 2, 32
#: Rules on words that occur in the given documents.
WORD_RULES = [
    Rule("license", 0, (r"all\s+rights\s+reserved|licen[cs]e",)),
    Rule("mail", 1, (r"\w@\w",)),
    Rule("address", 1, (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",)),
    Rule("marks", 2, (r"[#$%&*]{3}",)),
    Rule("bars", 2, (r" \| ",), never="the "),
    Rule("english", 0, (r"\bthe\b",), must="of "),
    Rule("insult", 2, (r"\b(stupid|worthless|pathetic)\b",)),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, game_date, load: quantities shipped by a supplier, a row a line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player_id"), F.col("l_shipdate").cast("date").alias("game_date"), F.col("l_quantity").alias("load"))


def dense_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, game_date, load: quantities shipped by a supplier a day."""
    return daily(shipments(spark, sf_dir), "player_id", "game_date", "load")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, load: values of a user's events a day."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.coalesce("value", F.lit(0.0)).alias("load"))
    return daily(rows, "user_id", "day", "load")


def orders_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def primary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of at least 0.98 of the largest price. The largest is one row, so its broadcast doesn't grow."""
    orders = orders_dated(spark, sf_dir)
    top = orders.agg((F.max("o_totalprice") * 0.98).alias("least"))
    return orders.crossJoin(F.broadcast(top)).filter("o_totalprice >= least").drop("least")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("debut", F.lit("1995-10-01").cast("date")).withColumnRenamed("c_custkey", "entity")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, season, position: customers with an order that season."""
    seen = orders_dated(spark, sf_dir).select(F.col("o_custkey").alias("entity"), season_year(F.col("day")).alias("season")).distinct()
    return seen.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("position")), "entity")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, season, position of each customer's first primary event."""
    first = primary_events(spark, sf_dir).groupBy(F.col("o_custkey").alias("entity")).agg(F.min("day").alias("day"))
    return first.withColumn("season", season_year(F.col("day"))).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("position")), "entity")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, t, e, pmf: a softmax of the embedding over two causes and 32 bins."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == CAUSES * BINS)
    logits = F.col("embedding").cast("array<double>")
    return rows.select("vec_id", (F.col("vec_id") * 7 % BINS).cast("int").alias("t"), (F.col("label") % 3).cast("int").alias("e"), softmax_pmf(logits, CAUSES, BINS).alias("pmf"))


def survival_rows(spark: SparkSession, sf_dir: str, bins: int = 12) -> DataFrame:
    """vec_id, f0 .. f7 (sums of eight components each), t, e for fitting hazards."""
    rows = table(spark, sf_dir, "embeddings")
    features = [sum((F.get("embedding", F.lit(8 * i + j)).cast("double") for j in range(1, 8)), F.get("embedding", F.lit(8 * i)).cast("double")).alias(f"f{i}") for i in range(8)]
    return rows.select("vec_id", *features, (F.col("vec_id") * 7 % bins).cast("int").alias("t"), (F.col("label") % 3).cast("int").alias("e"))
