"""Feature preparation: numeric columns, splits, scaling, shares and principal components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The play types, in order.
PLAY_TYPES = ["transition", "isolation", "pick_and_roll_ball_handler", "pick_and_roll_man", "post_up", "spot_up", "handoff", "cut", "off_screen", "putback", "misc"]


def numeric_columns(df: DataFrame, deny: list[str] = ()) -> list[str]:
    """Numeric columns but for a deny list; booleans, strings and dates aren't numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in deny]


def temporal_split(day: Column, train_before: int = 2020, val_before: int = 2022) -> Column:
    return F.when(F.year(day) < train_before, "train").when(F.year(day) < val_before, "val").when(day.isNotNull(), "test")


def split_leaks(rows: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities that occur in more than one split, with the number of them."""
    return rows.groupBy(entity).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, one pass; a deviation of 0 counts as 1."""
    row = train.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def stratified_holdout(rows: DataFrame, key: str, label: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with holdout: the share of each label that comes first in an order drawn by a hash of the key.

    Counts by the hash's first four digits tell the digits at which a label's share ends; only rows with those digits are ranked,
    so no task sorts a label. A null label is one too.
    """
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    marked = rows.withColumn("_h", drawn).withColumn("_p", F.substring("_h", 1, 4)).withColumn("_l", F.coalesce(F.col(label).cast("string"), F.lit("_null")))
    counts = marked.groupBy("_l", "_p").agg(F.count("*").alias("_k"))
    by = Window.partitionBy("_l")
    before = F.coalesce(F.sum("_k").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.select("_l", F.col("_p").alias("_at"), (F.floor(F.sum("_k").over(by) * share + 0.5) - before).alias("_left"), "_k")
    ends = ends.filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_k"))).select("_l", "_at", "_left")
    known = marked.join(F.broadcast(ends) if ends.count() <= 10_000 else ends, "_l", "left")
    sure = known.filter(F.col("_at").isNull() | (F.col("_p") != F.col("_at"))).withColumn("holdout", F.coalesce(F.col("_p") < F.col("_at"), F.lit(False)))
    edge = known.filter(F.col("_p") == F.col("_at")).withColumn("holdout", F.row_number().over(Window.partitionBy("_l").orderBy("_h", key)) <= F.col("_left"))
    return sure.unionByName(edge).select(*rows.columns, "holdout")


def category_shares(rows: DataFrame, keys: list[str], category: str, amount: str, categories: list[str] = PLAY_TYPES, prefix: str = "pt_") -> DataFrame:
    """The share of each category in the amount of a key, 0 where a key has none; the categories are given, so the
    columns don't vary with the data."""
    wide = rows.groupBy(*keys).pivot(category, categories).agg(F.sum(amount))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in categories), F.lit(0.0))
    return wide.select(*keys, *(F.coalesce(F.col(c) / F.when(total != 0, total), F.lit(0.0)).alias(f"{prefix}{c}") for c in categories))


def principal_components(rows: DataFrame, columns: list[str], k: int = 8, prefix: str = "ps_dim_", model=None):
    """rows with k components of the standardised columns, and the fitted (scaler, components) to reuse.

    Each component's sign is fixed by its largest loading.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    if model is None:
        scaler = fit_scaler(rows, columns)
        vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(scale(rows, scaler).na.fill(0.0, columns))
        loadings = PCA(k=min(k, len(columns)), inputCol="_v", outputCol="_p").fit(vectors).pc.toArray()
        signs = [1.0 if max(c, key=abs) >= 0 else -1.0 for c in loadings.T.tolist()]
        model = scaler, [[s * x for x in c] for s, c in zip(signs, loadings.T.tolist())]
    scaler, components = model
    unit = {c: F.coalesce((F.col(c) - m) / s, F.lit(0.0)) for c, (m, s) in scaler.items()}
    # arrays instead of a term for each column and component, whose code would grow with their product
    weights = F.lit([[float(x) for x in loading] for loading in components])
    total = lambda loading: F.aggregate(F.zip_with("_unit", loading, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    out = rows.withColumn("_unit", F.array(*(unit[c] for c in columns))).withColumn("_dims", F.transform(weights, total))
    return out.select(*rows.columns, *(F.get("_dims", F.lit(i)).alias(f"{prefix}{i}") for i in range(len(components)))), model
