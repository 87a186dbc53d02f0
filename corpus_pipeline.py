"""A training-data pipeline over documents: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridecast.llm import bpe, decontaminate, line_dedup, quality, simhash
from stridecast.llm.common import ensure_checkpoint_dir, table
from stridecast.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled documents, doesn't reject. A null text is empty, and stays or goes
    with the score of no evidence; rows are judged one by one, so repeated rows stay or go together."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that three documents or more hold, but for the largest id; n_chars follows the text. A null text becomes
    an empty one; rows without an id keep all lines; rows that repeat an id are one document when documents are counted."""
    kept = line_dedup.dedup_lines(docs, carry=True)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a similarity of 0.8 of their five-word shingles. All rows with a
    word are compared. Rows without an id stay, as do ids without a word; rows that repeat an id all stay or go, and go if each of their
    texts that has a word is a copy."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item or an edited copy of one. Rows without an id or a text stay; of rows that repeat
    an id all go if one holds an item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of what is left, encoded with a lexicon of its own frequent words. A row for each document; null and
    empty texts have no ids."""
    path = tokenizer_path()
    encoded = bpe.encode(docs, path, bpe.build_lexicon(docs, path))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", unique_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

#: A classifier and a tokenizer are stages, which SQL can't express; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each result is written as Parquet in the shared folder and read again by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
