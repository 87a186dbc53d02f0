"""Tables in files: CSV and JSON, appends that keep a header, nested records, worklists of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, dates: dict[str, str] | list[str] = ()) -> DataFrame:
    """A CSV with a header and declared types; columns in dates are read as text and parsed, bad dates being null."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in dates else f.dataType) for f in schema])
    rows = spark.read.schema(as_text).option("header", True).option("mode", "PERMISSIVE").csv(path)
    formats = dates if isinstance(dates, dict) else dict.fromkeys(dates)
    return rows.withColumns({c: parse_date(F.col(c), f) for c, f in formats.items()})


def parse_date(c: Column, pattern: str | None = None) -> Column:
    stamp = F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)
    return stamp.cast("date")


def overwrite(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Replace a table's files. What df reads must not be under path; write to a new place and swap if it is."""
    if any(f.removeprefix("file:").removeprefix("//").startswith(path.rstrip("/") + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is read by what would overwrite it")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def align(rows: DataFrame, columns: list[str], missing: str = "") -> DataFrame:
    """rows with exactly these columns in order, as text: lacking ones hold `missing`, others are dropped."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) if c in rows.columns else F.lit(missing).alias(c) for c in columns))


def append_csv(rows: DataFrame, path: str) -> None:
    """Append rows to a CSV, aligned to the header it has."""
    spark = rows.sparkSession
    columns = spark.read.option("header", True).csv(path).columns
    align(rows, columns).write.mode("append").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON of declared types: a file is an array of records, or one record a line, which Spark can split and which overwrite
    writes; ISO dates."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def flatten_frames(rows: DataFrame, column: str, record: str = "map<string,string>") -> DataFrame:
    """A JSON object of frame -> list of records as rows: the other columns, frame, position, record."""
    others = [c for c in rows.columns if c != column]
    frames = rows.select(*others, F.explode(F.from_json(column, f"map<string,array<{record}>>")).alias("frame", "_records"))
    return frames.select(*others, "frame", F.posexplode("_records").alias("position", "record"))


def page_files(spark: SparkSession, path: str, key: str = r"([^/]+?)(?:\.\w+)?$") -> DataFrame:
    """key (from the file's path, its name unless another pattern is given), modified, length and content of each file under the path.
    Spark lists the files; contents are read only where they are used, and filters of modified and length before that."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", key, 1).alias("key"), F.col("modificationTime").alias("modified"), "length", "content")


def archive_pages(rows: DataFrame, path: str) -> None:
    """Append pages (key, content: bytes, a key once) to an archive, whose files hold many pages each. A file a page costs each page
    the making of a file and a folder, and each listing a folder; here there are as many files as rows have parts, however many pages."""
    rows.select(F.col("key").cast("string").alias("key"), F.col("content").cast("binary").alias("content")).write.mode("append").parquet(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_files of an archive: key, modified (of the file that holds the page), length, content of each page as often as it was archived.
    Contents are read only where they are used, and of files within what modified is filtered to."""
    files = spark.read.schema("key string, content binary").parquet(path)
    return files.select("key", F.col("_metadata.file_modification_time").alias("modified"), F.octet_length("content").cast("long").alias("length"), "content")


def _latest(rows: DataFrame) -> DataFrame:
    """Of each key the row modified last; of equal times that of the largest sha256."""
    columns = [c for c in rows.columns if c != "key"]
    last = rows.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("modified", "sha256")).alias("_last"))
    return last.select("key", *(F.col("_last")[c].alias(c) for c in columns))


def decoded(content: Column) -> Column:
    """The text of a page's bytes, by the charset that its first kilobyte names: UTF-8 unless that is a Latin one; bytes that don't fit
    are replaced."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    latin = F.rlike(head, F.lit(r"(?i)charset=[\"']?\s*(iso-8859-1|latin-?1|windows-1252|us-ascii)\b"))
    return F.when(latin, F.decode(content, "ISO-8859-1")).otherwise(F.make_valid_utf8(content.cast("string")))


def scan_pages(spark: SparkSession, path: str, key: str = r"([^/]+?)(?:\.\w+)?$") -> DataFrame:
    """key, html, modified, sha256 (of the bytes): one row a cached file."""
    return page_files(spark, path, key).select("key", decoded(F.col("content")).alias("html"), "modified", F.sha2("content", 256).alias("sha256"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """key (the file's name, the md5 of its address), html: one row a cached file."""
    return scan_pages(spark, path).select("key", "html")


def changed_pages(spark: SparkSession, path: str, seen: DataFrame, key: str = r"([^/]+?)(?:\.\w+)?$") -> DataFrame:
    """scan_pages of the files that are new, or changed, since the run whose key, modified and sha256 are in seen.

    Contents are read of the files not older than the last one seen, a filter that the file source applies; files that came late, with an
    older time but an unknown key, are found from the listing alone, and read within their range of times. A file that was
    written again with the same bytes isn't changed.
    """
    rows = _unseen(page_files(spark, path, key), seen)
    return rows.select("key", decoded(F.col("content")).alias("html"), "modified", "sha256")


def seen_in_archive(spark: SparkSession, path: str) -> DataFrame:
    """key, modified, sha256 (of the bytes) of an archive's pages as they were archived last; contents don't move."""
    return _latest(archived_pages(spark, path).select("key", "modified", F.sha2("content", 256).alias("sha256")))


def changed_in_archive(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """changed_pages of an archive: key, html, modified, sha256 of the pages that are new or changed, as they were archived last."""
    rows = _latest(_unseen(archived_pages(spark, path), seen).select("key", "modified", "content", "sha256"))
    return rows.select("key", decoded(F.col("content")).alias("html"), "modified", "sha256")


def _unseen(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """The pages listed whose key, with their sha256, isn't in seen; see changed_pages."""
    last = seen.agg(F.max("modified").alias("m")).first()["m"]
    if last is None:
        return listed.withColumn("sha256", F.sha2("content", 256))
    known = seen.select(F.col("key").alias("_key"), F.col("sha256").alias("_sha"))
    late = listed.filter(F.col("modified") < F.lit(last)).select("key", "modified").join(known, F.col("key") == F.col("_key"), "left_anti")
    span = late.agg(F.min("modified").alias("a"), F.max("modified").alias("b")).first()
    fresh = listed.filter(F.col("modified") >= F.lit(last))
    if span["a"] is not None:
        older = listed.filter((F.col("modified") >= F.lit(span["a"])) & (F.col("modified") <= F.lit(span["b"])) & (F.col("modified") < F.lit(last)))
        fresh = fresh.union(older.join(known, F.col("key") == F.col("_key"), "left_anti"))
    rows = fresh.withColumn("sha256", F.sha2("content", 256))
    return rows.join(known, (F.col("key") == F.col("_key")) & (F.col("sha256") == F.col("_sha")), "left_anti")


def page_key(url: Column) -> Column:
    return F.md5(url)


def worklist(expected: DataFrame, done: DataFrame, url: str, done_key: str = "key") -> DataFrame:
    """Expected rows whose key isn't stored yet."""
    return expected.join(done.select(F.col(done_key).alias("_done")), page_key(F.col(url)) == F.col("_done"), "left_anti")


def days_by_edition(spark: SparkSession, first: str, last: str, editions: list[str]) -> DataFrame:
    """day, edition for each day of a range."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.select("day", F.explode(F.array(*(F.lit(e) for e in editions))).alias("edition"))


def entity_seasons(entities: DataFrame, entity: str, first: str, last: str, low: int, high: int) -> DataFrame:
    """entity, season for each season of an entity's range within low .. high; a missing end is open."""
    begin, end = F.greatest(F.coalesce(first, F.lit(low)), F.lit(low)), F.least(F.coalesce(last, F.lit(high)), F.lit(high))
    return entities.select(entity, begin.cast("int").alias("_a"), end.cast("int").alias("_b")).filter("_a <= _b").select(entity, F.explode(F.sequence("_a", "_b")).alias("season"))


def season_labels(spark: SparkSession, first: int, last: int) -> DataFrame:
    from stridecast.functions.scalars import season_label

    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("season"), season_label(F.col("id").cast("int")).alias("label"))
