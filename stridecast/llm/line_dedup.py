"""Line dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import broadcast_if_small, ensure_checkpoint_dir

#: Documents of a hash that is broadcast; only the plan depends on it.
HOT = 1000
#: The white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased; the cheap lower() serves lines of ASCII."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_length: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Drop lines whose key of at least min_length code points is in min_docs documents or more, except in the largest id.

    Returns doc_id, text, n_lines, n_dropped; with carry instead the columns of docs, the text being what is left. A null or
    empty text is one empty line. Rows that share an id are one document when documents are counted, and each
    keeps its own lines. Rows without an id take no part in the counts and keep all their lines. Keys are compared
    by 128 bits of hash.

    Only hashes are exploded and dealt; text moves once, to meet the positions dropped from it. A hash that many documents hold
    is summed before the shuffle; those of over HOT documents are few (so many lines are behind each), and their lines meet
    them by broadcast and are dealt by document, so that no task gathers the lines of one hash.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    whole = F.struct(*(docs[c] for c in docs.columns)) if carry else F.lit(None).cast("string")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), whole.alias("row"))
    texts = texts.withColumn("row_hash", F.xxhash64("text"))
    lines = (
        texts.filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_length))
        .select("doc_id", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .filter(F.char_length(F.btrim("line", F.lit(SPACE))) >= min_length)
        .withColumn("key", line_key(F.col("line")))
        .select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    common = (
        lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .checkpoint()
    )
    hot = broadcast_if_small(common.filter(F.col("n_docs") > HOT).select("h1", "h2", F.col("keeper").alias("hot_keeper")))
    rest = common.filter(F.col("n_docs") <= HOT).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keeper")
    # a hot line has its keeper by now; what it is dealt by then only spreads it
    dealt = F.when(F.col("hot_keeper").isNotNull(), F.xxhash64("doc_id", "pos")).otherwise(F.col("h1"))
    keeper = F.coalesce("hot_keeper", "keeper")
    dropped = (
        lines.join(hot, ["h1", "h2"], "left").withColumn("dealt", dealt)
        .join(rest, (F.col("dealt") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
        .filter(keeper.isNotNull() & (F.col("doc_id") != keeper))
        .groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("dropped"))
        .withColumnsRenamed({"doc_id": "d_id", "row_hash": "d_hash"})
    )
    joined = texts.join(dropped, (F.col("doc_id") == F.col("d_id")) & (F.col("row_hash") == F.col("d_hash")), "left")
    parts = F.split("text", "\n", -1)

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # a lambda's variable holds the lines, so that the text is split once and not for each line
    left = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(parts), rest), F.lit(0)))
    if carry:
        return joined.select(*(left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
    return joined.select(
        "doc_id",
        left.alias("text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs),
lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM parts)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
