"""Approximate nearest neighbours with a permutation index: ordered nearest pivots, pivot inverted files, footrule, rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridecast.llm.common import ensure_checkpoint_dir, ragged

#: Rows of one part of a pivot's inverted file, and queries that visit it together, at most.
PART, VISITORS = 16_384, 4_096
#: Numbers of a matrix of vectors by pivots that a task holds at once.
CELLS = 4_000_000


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (floats as they are, else doubles) of the rows that take part: an id, and a vector that isn't null, empty
    or zero and holds no null or non-finite component. Of rows that share an id the one with the largest vector counts."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<float>" if single else "array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector by inner product over the vector's length, nearest first."""
    step = max(1, CELLS // len(pivots))
    out = np.empty((len(vectors), prefix), np.int32)
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        near = -((part / np.linalg.norm(part, axis=1, keepdims=True)) @ pivots.T)
        first = np.argpartition(near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(prefix), (len(part), 1))
        order = np.lexsort((first, np.take_along_axis(near, first, 1)), axis=1)
        out[at : at + step] = np.take_along_axis(first, order, 1)
    return out


def saved_by(shared_query: np.ndarray, shared_row: np.ndarray, prefix: int) -> np.ndarray:
    """What a shared pivot takes off half the footrule of two prefixes, a missing pivot counting as one after the last.

    The footrule is prefix * (prefix + 1) less twice the sum of these, so the largest sum is the smallest footrule.
    """
    return prefix - np.maximum(shared_query, shared_row)


class InvertedFiles:
    """The rows of one part of a pivot's list, with files that tell for each pivot which of them have it and at what rank."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, perms: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, perms = ids[order], vectors[order], perms[order]
        n, self.prefix = perms.shape
        order = np.argsort(perms.ravel(), kind="stable")
        self.rows, self.ranks = order // self.prefix, order % self.prefix
        self.pivots, first = np.unique(perms.ravel()[order], return_index=True)
        self.first, self.size = first, np.diff(np.append(first, n * self.prefix))

    def search(self, query: np.ndarray, perm: np.ndarray, here: int, posted: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, by exact score, of the rows that save `least` or more of the footrule, and of the k
        that save most. Rows that share a pivot before `here` with the query are left to that pivot's list."""
        at = np.minimum(np.searchsorted(self.pivots, perm), len(self.pivots) - 1)
        known = np.flatnonzero(self.pivots[at] == perm)
        at = at[known]
        rows, ranks = ragged(self.rows, self.first[at], self.size[at]), ragged(self.ranks, self.first[at], self.size[at])
        asked = np.repeat(known, self.size[at])
        saved = np.bincount(rows, saved_by(asked, ranks, self.prefix), len(self.ids))
        mine = np.flatnonzero(perm == here)[0]
        saved[rows[(ranks < posted) & (asked < mine)]] = -1
        near = np.flatnonzero(saved >= least)
        if len(near) < k:
            near = np.argsort(-saved, kind="stable")[:k]
            near = near[saved[near] >= 0]
        scores = (self.vectors[near] * query).sum(axis=1)
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near[best]], scores[best]


@dataclass
class Plan:
    """posted: files that a row is posted in; probes: files that a query visits; least: what a row must save of the footrule to
    be scored; recall: of the sample's true neighbours, the share found so."""

    posted: int
    probes: int
    least: int
    recall: float


def calibrate(queries: np.ndarray, neighbours: np.ndarray, owner: np.ndarray, posted: int, recall: float) -> Plan:
    """From permutations of sampled queries and of their true neighbours (owner: whose each is): the fewest probes that
    reach a share of recall + (1 - recall) / 2 of them, and the largest `least` that leaves the share `recall`. Where no
    number of probes reaches as many, rows are posted twice as often, up to all of their prefix."""
    prefix, wanted = queries.shape[1], recall + (1 - recall) / 2
    if not len(owner):
        return Plan(posted, prefix, 0, 1.0)
    shared = [np.nonzero(queries[q][:, None] == row[None, :]) for q, row in zip(owner.tolist(), neighbours)]
    saved = np.array([saved_by(asked, ranks, prefix).sum() for asked, ranks in shared])
    while True:
        reach = np.array([asked[ranks < posted].min(initial=prefix) for asked, ranks in shared])
        if (reach < prefix).mean() >= wanted or posted == prefix:
            break
        posted = min(2 * posted, prefix)
    probes = min(prefix, int(np.quantile(reach, wanted, method="higher")) + 1)
    met = np.sort(np.where(reach < probes, saved, -1))
    least = max(0, int(met[int((1 - recall) * len(met))]))
    return Plan(posted, probes, least, float((met >= least).mean()))


def true_neighbours(rows: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, vector) of the k rows of the largest inner product with each of a few queries: one pass over all rows, k rows
    a query from each task."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, own))

    def best(batches):
        import pyarrow as pa

        q, mine = sent.value
        kept: list[list] = [[] for _ in q]

        def cut(found):
            return sorted(found, key=lambda x: (-x[0], x[1]))[:k]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, flat = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            scores = np.where(ids[None, :] == mine[:, None], -np.inf, q @ flat.T)
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
            for i in range(len(q)):
                kept[i] = cut(kept[i] + [(scores[i, j], ids[j], flat[j].copy()) for j in top[i].tolist() if np.isfinite(scores[i, j])])
        out = [(i, *x) for i, found in enumerate(kept) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3].tolist() for x in out], pa.list_(pa.float64()))], ["owner", "score", "vec_id", "vector"])

    found = rows.select("vec_id", "vector").mapInArrow(best, "owner int, score double, vec_id long, vector array<double>")
    order = Window.partitionBy("owner").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("owner", "vector").collect()
    return np.array([r.owner for r in found], np.int64), np.array([r.vector for r in found], float).reshape(len(found), queries.shape[1])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, n_pivots: int | None = None, prefix: int = 96, posted: int = 8, recall: float = 0.95, sample: int = 256, part: int = PART, visitors: int = VISITORS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the rows whose id is divisible by `every`.

    1. Pivots are the vectors of n_pivots ids chosen by a hash of the id (128 and twice the root of the number of rows,
       unless given). Each row is represented by its `prefix` nearest pivots in order and posted in the inverted files of
       the first `posted` of them. 2. `sample` rows, chosen by another hash, are compared with all rows; from the
       permutations of their true neighbours follow how many of its own pivots' files a query visits, and the footrule up to which
       rows are scored, so that the share `recall` is found (see calibrate; `posted` and `prefix` grow where they can't give
    it). No share of the rows or least number is set, so the
       rule is the same at every size. 3. Queries meet rows in the files of their pivots, one task a file; a pair is looked at
       in the first file that it shares only. A file gives its k best by the exact score.

    Rows move `posted` times and queries as often as they probe: linear in both. Files of more than `part` rows or `visitors`
    queries are split. Of equal vectors the k + 1 smallest ids are posted, as no other can be among the k nearest, and equal queries search
    once; so copies of one vector make no large file. A query that finds fewer rows than there are is compared with all rows in
    blocks. Vectors not of the usual length take no part; an empty table has no result. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = clean_vectors(vectors, id_col, vector_col).withColumn("size", F.size("vector")).checkpoint()
    usual = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("size") == usual["size"]).drop("size").withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("vector"), "vector")})
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    indexed = rows.withColumn("copy", place).filter(F.col("copy") <= k + 1).drop("copy").checkpoint()
    asked = rows.filter(F.col("vec_id") % every == 0)
    members = asked.select("vec_id", F.min("vec_id").over(Window.partitionBy("h1", "h2")).alias("q"))
    asked = asked.withColumn("copy", place).filter("copy = 1").select("vec_id", "vector")

    n_rows = indexed.count()
    n_pivots = n_pivots or 128 + 2 * math.isqrt(n_rows)
    drawn = lambda salt, n: indexed.orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(n).select("vec_id", "vector").collect()
    pivots = np.unique(np.array([r.vector for r in drawn("pivot", n_pivots)], float), axis=0)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    prefix, posted = min(prefix, len(pivots)), min(posted, len(pivots))
    tried = drawn("sample", sample)
    queries = np.array([r.vector for r in tried], float)
    owner, theirs = true_neighbours(indexed, queries, np.array([r.vec_id for r in tried], np.int64), k)
    while True:
        plan = calibrate(permutations(queries, pivots, prefix), permutations(theirs, pivots, prefix), owner, posted, recall)
        if plan.recall >= recall or prefix == len(pivots):  # longer prefixes share more
            break
        prefix = min(2 * prefix, len(pivots))

    kind = indexed.schema["vector"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(pivots)

    def represent(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                flat = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                perms = permutations(flat, sent.value, prefix)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in perms], pa.binary()), pa.array(perms.tolist(), pa.list_(pa.int32()))], ["vec_id", "vector", "perm", "near"])

    def in_files(df, n):
        return df.mapInArrow(represent, f"vec_id long, vector {kind}, perm binary, near array<int>").withColumn("near", F.slice("near", 1, n)).checkpoint()

    data, asked = in_files(indexed.select("vec_id", "vector"), plan.posted), in_files(asked, plan.probes)
    posts = lambda df: df.select(F.explode("near").alias("pivot")).groupBy("pivot")
    parts = lambda name, most: F.ceil(F.count("*") / most).cast("int").alias(name)
    # one row a pivot: as few as the pivots
    sizes = F.broadcast(posts(data).agg(parts("parts", part)).join(posts(asked).agg(parts("groups", visitors)), "pivot"))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = data.select("vec_id", "vector", "perm", F.explode("near").alias("pivot")).join(sizes, "pivot").select("pivot", dealt("parts").alias("part"), each("groups").alias("visit"), "vec_id", "vector", "perm")
    visits = asked.select("vec_id", "vector", "perm", F.explode("near").alias("pivot")).join(sizes, "pivot").select("pivot", each("parts").alias("part"), dealt("groups").alias("visit"), "vec_id", "vector", "perm")
    schema = "q long, score double, vec_id long"

    def table(out):
        import pyarrow as pa

        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], names=["q", "score", "vec_id"])

    def matrix(column):
        column = column.combine_chunks()
        return np.asarray(column.flatten(), float).reshape(len(column), -1)

    def visit(key, queries, found):
        out = []
        if queries.num_rows and found.num_rows:
            perms = lambda t: np.frombuffer(b"".join(t["perm"].to_pylist()), np.int32).reshape(-1, prefix)
            files = InvertedFiles(np.asarray(found["vec_id"]), matrix(found["vector"]), perms(found))
            for i, v, p in zip(queries["vec_id"].to_pylist(), matrix(queries["vector"]), perms(queries)):
                ids, scores = files.search(v, p, key[0].as_py(), plan.posted, k + 1, plan.least)
                out.append((np.full(len(ids), i), scores, ids))
        return table(out)

    keys = ["pivot", "part", "visit"]
    found = visits.groupBy(*keys).cogroup(listed.groupBy(*keys)).applyInArrow(visit, schema)
    hits = F.struct((-F.col("score")).alias("far"), "vec_id")

    def best(found):
        # a file gives k + 1 rows a query at most, so the list is as long as the files visited times that
        return found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(hits)), 1, k + 1).alias("hits"))

    done = best(found).checkpoint()
    enough = done.filter(F.size("hits") >= min(k + 1, n_rows))
    lacking = asked.select("vec_id", "vector").join(enough.select(F.col("q").alias("vec_id")), "vec_id", "left_anti").checkpoint()
    if not lacking.isEmpty():
        n_lacking = lacking.count()

        def compare(key, queries, found):
            out = []
            if queries.num_rows and found.num_rows:
                ids, m = np.asarray(found["vec_id"]), matrix(found["vector"])
                for i, v in zip(queries["vec_id"].to_pylist(), matrix(queries["vector"])):
                    scores = (m * v).sum(axis=1)
                    order = np.lexsort((ids, -scores))[: k + 1]
                    out.append((np.full(len(order), i), scores[order], ids[order]))
            return table(out)

        n_data, n_query = -(-n_rows // part), -(-n_lacking // visitors)
        block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = lacking.select(block(n_query).alias("b"), all_of(n_data).alias("d"), "vec_id", "vector")
        right = indexed.select(all_of(n_query).alias("b"), block(n_data).alias("d"), "vec_id", "vector")
        done = enough.union(best(left.groupBy("b", "d").cogroup(right.groupBy("b", "d")).applyInArrow(compare, schema)))
    answers = members.withColumnRenamed("vec_id", "query_id").join(done, "q")
    others = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
