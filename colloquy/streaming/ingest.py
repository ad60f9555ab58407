"""Incremental ingest: a stream of transcript files becomes stored meetings, turns and chunks; each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.guardrails import injection_hits
from colloquy.functions.text import checksum, estimate_tokens
from colloquy.operators.chunk import chunk_transcript
from colloquy.operators.parse import date_from_filename, normalise_date, parse_turns, participants, read_headers, title_from_filename, warnings
from colloquy.plans.retrieve import analysed, indexed
from colloquy.settings import Settings
from colloquy.sources.scratch import written
from colloquy.sources.store import Store
from colloquy.sources.transcripts import checked_files


#: Fixed value: the warning of a transcript with text like instructions.
INJECTED = "This transcript contains text that resembles prompt instructions. It is treated as data, but check answers that draw on it."


def ingest(store: Store, files: DataFrame, settings: Settings = Settings()) -> int:
    """Store the files (filename, content, and title, date and error where a request gives them) that are not stored yet; gives the store's version.

    Title, date and participants come from the request, the transcript's header, its body or the file's name, in this order. A file that comes with
    an error, or without a turn, goes to ``rejected``; chunks are stored with their embedding, and their words as an inverted index.
    """
    given = lambda c: F.col(c).cast("string") if c in files.columns else F.lit(None).cast("string")
    files = files.select("filename", "content", given("title").alias("title"), given("date").alias("date"), given("error").alias("error"))
    # a file whose content can't be kept goes by its name
    files = written(files.withColumn("error", F.when(F.col("error").isNull() & F.col("content").isNull(), "content").otherwise(F.col("error"))).withColumn("id", checksum(F.coalesce("content", "filename", F.lit("")))), "received")
    fresh = written(store.new_only(files.where("error is null").drop("error")), "files")
    failed = files.where("error is not null").select("id", "filename", "error").dropDuplicates(["id"])
    if not fresh.take(1):
        return store.save(rejected=failed)
    turns = written(parse_turns(fresh.select("id", "content")), "turns")
    head = read_headers(fresh.select("id", "content")).withColumnsRenamed({"title": "said", "date": "dated"})
    counts = turns.groupBy("id").agg(F.first("format").alias("format"), F.count("*").cast("int").alias("turn_count"), F.max_by("end_ms", "index").alias("duration_ms"))
    people = participants(turns, head.where("participants is not null").select("id", "participants"))
    chunks = written(chunk_transcript(turns, settings), "chunks")
    n_chunks = chunks.groupBy("id").agg(F.count("*").cast("int").alias("chunk_count"))
    injected = F.when(F.size(injection_hits(F.col("content"))) > 0, F.array(F.lit(INJECTED))).otherwise(F.array().cast("array<string>"))
    full = fresh.join(counts, "id").join(head.select("id", "said", "dated"), "id", "left").join(people, "id", "left").join(warnings(turns), "id", "left").join(n_chunks, "id", "left")
    meetings = full.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), "said", title_from_filename(F.col("filename"))).alias("title"),
        F.coalesce(normalise_date(F.nullif("date", F.lit(""))), "dated", date_from_filename(F.col("filename"))).alias("date"), F.col("filename").alias("source"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), "format", "turn_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "duration_ms",
        estimate_tokens(F.col("content")).alias("token_count"), F.coalesce("participants", F.array().cast("array<string>")).alias("participants"),
        F.concat(F.coalesce("warnings", F.array().cast("array<string>")), injected).alias("warnings"), F.col("content").alias("transcript"),
    )
    meetings = written(meetings, "meetings")
    named = meetings.select(F.col("id").alias("meeting_id"), "title", "date")
    rejected = fresh.join(counts.select("id"), "id", "left_anti").select("id", "filename", F.lit("No dialogue found.").alias("error"))
    rejected = rejected.unionByName(failed)
    own = chunks.withColumnRenamed("id", "meeting_id").withColumn("chunk_id", F.concat_ws(":", "meeting_id", F.col("ordinal").cast("string")))
    return store.save(
        meetings=meetings, turns=turns, chunks=analysed(own.drop("chunk_id"), named).withColumnRenamed("meeting_id", "id"),
        postings=indexed(own).withColumnRenamed("part", "id"), rejected=rejected,
    )


def ingest_stream(spark: SparkSession, path: str, store: Store, checkpoint: str, settings: Settings = Settings(), most: int = 1000) -> StreamingQuery:
    """Follow a folder of transcript files, ``most`` a batch; bad files are rejected in the batch that met them. A batch that is run again finds its meetings stored and adds nothing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most).load(path)
    files = checked_files(files)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest(store, df, settings)).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and tumbling window, with a watermark where ``events`` is a stream."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
