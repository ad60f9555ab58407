"""Readers of transcripts and evaluation sets, and writers of events and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files larger than this become error rows.
MAX_BYTES = 4 << 20


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, error): transcript files of a folder; one that is too large or not UTF-8 fails alone."""
    return checked_files(spark.read.format("binaryFile").load(path))


def checked_files(files: DataFrame) -> DataFrame:
    """The transcript files among ``files`` (path, length, content) by their extension, of any case."""
    files = files.where(F.lower("path").rlike(r"\.(txt|md|vtt|srt)$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    good = (F.col("length") <= MAX_BYTES) & F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(F.col("length") > MAX_BYTES, "file is larger than 4 MiB").when(~good, "file is not UTF-8")
    return files.select(name.alias("filename"), F.when(good, F.col("content").cast("string")).alias("content"), error.alias("error"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of an evaluation file."""
    case = "cases array<struct<id:string,question:string,mustRetrieve:array<string>,shouldMention:array<string>,expectRefusal:boolean,note:string>>"
    return spark.read.schema(case).json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def check_requests(requests: DataFrame) -> DataFrame:
    """Adds error to ingest requests (filename, content, title, date): null where they may pass."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return requests.withColumn("error", F.when(~n("filename").between(1, 200), "filename").when(size < 1, "content").when(size > MAX_BYTES, "too large").when(n("title") > 200, "title").when(n("date") > 40, "date"))


def segments_to_lines(segments: DataFrame) -> DataFrame:
    """(id, content): timed speech segments (id, seq, start_ms, speaker, text) as bracketed lines."""
    s = F.floor(F.col("start_ms") / 1000)
    line = F.format_string("[%02d:%02d:%02d] %s: %s", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, F.coalesce("speaker", F.lit("Speaker")), "text")
    return segments.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines; events: (query_id, seq, event)."""
    events.repartitionByRange("query_id", "seq").sortWithinPartitions("query_id", "seq").select("event").write.mode("overwrite").text(path)
