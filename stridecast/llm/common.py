"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python at most so many rows at a time in this session: Spark's 10,000 rows of long texts are held several
    times over, by the JVM outside its heap and by the worker. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash; in small batches where Python reads them."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; where none is set, a local one on a local master (tests), and
    else an error, as executors would not share it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def broadcast_if_small(ids: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """Ids (8 bytes a row) to join large rows with: written, counted, and broadcast up to most_rows; beyond, Spark shuffles.

    The number only chooses the plan of the join: the rows that come out are the same on either side of it."""
    ensure_checkpoint_dir(ids.sparkSession)
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= most_rows else ids


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among ids (one column of longs), columns as they were; rows without an id stay.
    The column of ids gets a name that docs doesn't have, whatever its own are."""
    name = max(docs.columns, key=len) + "_gone"
    gone = broadcast_if_small(ids.toDF(name))
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")


def held_out(doc_id: Column) -> Column:
    """Rows kept away from every fit: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[start : start + length] for all given starts."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(total)
    return values[index]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the n + 1 offsets of its values; nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8), offsets


def slices(batches, max_bytes: int = 1 << 20):
    """Cut Arrow batches whose second column is text into slices of about max_bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
