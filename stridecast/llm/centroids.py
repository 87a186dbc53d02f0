"""Centroid clustering of integer vectors: equal-average equal-variance search for the nearest centroid, exact in integers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridecast.llm.common import ensure_checkpoint_dir

#: Integers at or beyond this have squared distances that a long can't hold.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (the integers floor(scale * x) as little-endian 32-bit bytes) of the vectors of exactly `dims` components, none null
    or non-finite. Rows that repeat an id are rows of their own, and so are rows without an id. A vector with an integer beyond
    LARGEST takes no part, as its distances wouldn't fit a long."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    rows = rows.filter((F.size("v") == dims) & fits)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.floor(scale * np.asarray(batch.column(1).flatten(), np.float64)).astype("<i4").reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


class Codebook:
    """Centroids in the order of their component sums (their means, times the length), with the norms of their deviations."""

    def __init__(self, centroids: np.ndarray):
        self.numbers = np.lexsort((np.arange(len(centroids)), centroids.sum(axis=1)))
        self.centroids = centroids[self.numbers]
        self.sums = self.centroids.sum(axis=1)
        self.deviations = self._deviations(self.centroids, self.sums)

    @staticmethod
    def _deviations(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        return np.sqrt(np.square(n * x.astype(float) - sums[:, None]).sum(axis=1)) / n

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number and the squared distance of the nearest centroid of each row (ties: smaller number), and how many distances that took.

        By each row's mean centroids are visited outwards, the nearer of the next lower and the next higher one first. The
        squared distance is at least n times the squared difference of the means, so a row is done once that exceeds its
        best; with the squared difference of the deviations' norms added it is a bound still, which rejects one centroid. What
        is left is summed in 64-bit integers. The bounds give way by a rounding error, so that no tie is lost to it.
        """
        n, k = x.shape[1], len(self.sums)
        sums = x.sum(axis=1)
        deviations = self._deviations(x, sums)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        best = np.full(len(x), np.iinfo(np.int64).max)
        number = np.full(len(x), k)
        rows, tried = np.arange(len(x)), 0
        for _ in range(k):
            down = np.where(low[rows] >= 0, sums[rows] - self.sums[np.maximum(low[rows], 0)], np.iinfo(np.int64).max)
            up = np.where(high[rows] < k, self.sums[np.minimum(high[rows], k - 1)] - sums[rows], np.iinfo(np.int64).max)
            lower = down <= up
            c = np.where(lower, low[rows], high[rows])
            low[rows[lower]] -= 1
            high[rows[~lower]] += 1
            means = np.square(np.minimum(down, up).astype(float)) / n
            limit = best[rows] * (1 + 1e-9) + 1e-3
            open_rows = means <= limit
            rows, c, means, limit = rows[open_rows], c[open_rows], means[open_rows], limit[open_rows]
            if not len(rows):
                break
            near = means + np.square(deviations[rows] - self.deviations[c]) <= limit
            r, c = rows[near], c[near]
            found = np.square(x[r] - self.centroids[c]).sum(axis=1)
            tried += len(r)
            better = (found < best[r]) | ((found == best[r]) & (self.numbers[c] < number[r]))
            best[r[better]], number[r[better]] = found[better], self.numbers[c[better]]
        return number, best, tried


def _matrices(batches, dims: int, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def sums_by_cluster(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each cluster with rows: their number and the sums of their components. Each task adds up its own rows; only clusters times
    components numbers reach the driver."""
    dims = centroids.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(Codebook(centroids))

    def run(batches):
        import pyarrow as pa

        total, counts = np.zeros((len(centroids), dims + 1), np.int64), np.arange(len(centroids))
        for _, x in _matrices(batches, dims):
            number = sent.value.assign(x)[0]
            order = np.argsort(number, kind="stable")
            there, first = np.unique(number[order], return_index=True)
            total[there, :dims] += np.add.reduceat(x[order], first, axis=0)
            total[there, dims] += np.diff(np.append(first, len(x)))
        some = np.flatnonzero(total[:, dims])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(counts[some], dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(some)), pa.int32()), pa.array(total[some].ravel(), pa.int64())], ["cluster", "at", "total"])

    parts = rows.mapInArrow(run, "cluster int, at int, total long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault(r.cluster, [0] * (dims + 1))[r["at"]] = int(r.total)
    return {c: (v[dims], v[:dims]) for c, v in found.items()}


def fit_centroids(rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", dims: int = 64) -> np.ndarray:
    """The centroids after `rounds` rounds over all rows of whole_vectors. They start as the k vectors of the smallest SHA-256 of `salt:id`
    (rows of one id by their vector, those without an id last), fewer if there are fewer rows, none if there are none. Each
    round moves every centroid that has rows to their mean, rounded down. It stops early where nothing moves, as then
    nothing would."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (count, total) in sums_by_cluster(rows, centroids).items():
            moved[c] = [s // count for s in total]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign_vectors(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each row of whole_vectors. No shuffle."""
    dims = centroids.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(Codebook(centroids))

    def run(batches):
        import pyarrow as pa

        for batch, x in _matrices(batches, dims):
            number, distance, _ = sent.value.assign(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that whole_vectors keeps; see there and
    fit_centroids for nulls, repeats and few rows. An empty table has no result. Inertias that a long can't hold are null.

    Vectors are written once, as integers, and read once a round; a round sends the k centroids out and k times `dims` sums back.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = whole_vectors(vectors, dims, scale, id_col, vector_col).checkpoint()
    centroids = fit_centroids(rows, k, rounds, salt, dims)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    found = assign_vectors(rows, centroids).checkpoint()
    spread = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda s: s if s < 1 << 63 else None
    named = [(c, held(s), held(sum(spread.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in spread.items()]
    facts = T._parse_datatype_string("named int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return found.join(F.broadcast(spark.createDataFrame(named, facts)), F.col("cluster") == F.col("named")).drop("named")


def oracle(k: int = 8, rounds: int = 10) -> str:
    """The same for DuckDB: every distance, round by round."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT v.vec_id, v.x, c{i}.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c{i}.x)]) AS d FROM v, c{i}) "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"
        )
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM (SELECT c, i, SUM(y) AS s, COUNT(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)"
        )
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, COALESCE(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)")
    last = f"a{rounds}"
    return (
        "WITH " + ", ".join(parts[:-2]) + f" SELECT {last}.vec_id, CAST({last}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(SUM(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON c{rounds}.c = {last}.c"
    )
