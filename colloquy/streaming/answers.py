"""Questions as a stream: each conversation's past questions are kept as state, and every micro-batch is answered as one plan.

A question gets the last HISTORY questions that its conversation asked before it, by time of asking, whatever the order of arrival. One so
late that a full state no longer holds its history becomes an error event. Conversations that fall silent for IDLE_MS are forgotten by a
timer, which fires with the next batch that has data. A batch that is run again writes the same folder, so no event is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.engine import Engine
from colloquy.operators import answer
from colloquy.sources.scratch import written

#: Questions of a history, those kept per conversation, so that late ones find theirs, and the silence after which they go.
HISTORY, KEPT, IDLE_MS = 6, 18, 24 * 3600 * 1000
TURNS = "array<struct<role:string,content:string>>"
SHAPE = f"conversation_id string, query_id string, text string, history {TURNS}, error string"
LATE = "The question came after its conversation's history was gone."


def remember(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The new questions of one conversation with their history, in the order of asking. The state holds the last questions as (asked_at, query_id, text) lists."""
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat(list(frames))
    new = sorted(zip(new["asked_at"].tolist(), new["query_id"].tolist(), new["text"].tolist()))
    held = list(zip(*state.get)) if state.exists else []
    full, out = len(held) >= KEPT, []
    for at, query_id, text in new:
        before = [t for t in held if t[:2] < (at, query_id)][-HISTORY:]
        late = full and len(before) < HISTORY  # what came before may have gone
        out.append((key[0], query_id, text, [{"role": "user", "content": t[2]} for t in before], LATE if late else None))
        if not late:
            held = sorted([*held, (at, query_id, text)])
    kept = held[-KEPT:]
    state.update(tuple([t[k] for t in kept] for k in range(3)))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["conversation_id", "query_id", "text", "history", "error"])


def with_history(questions: DataFrame) -> DataFrame:
    """Adds history and error to ``questions`` (conversation_id, query_id, text, asked_at), a stream or not."""
    asked = questions.select("conversation_id", "query_id", "text", "asked_at")
    if not questions.isStreaming:
        before = Window.partitionBy("conversation_id").orderBy("asked_at", "query_id").rowsBetween(-HISTORY, -1)
        turn = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
        return asked.withColumn("history", F.collect_list(turn).over(before)).withColumn("error", F.lit(None).cast("string")).drop("asked_at")
    keyed = asked.withColumn("asked_at", F.unix_micros("asked_at")).groupBy("conversation_id")
    return keyed.applyInPandasWithState(remember, SHAPE, "asked_at array<long>, query_id array<string>, text array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def events(engine: Engine, asked: DataFrame) -> DataFrame:
    """(query_id, seq, event) of questions that have their history; an error event for each that has an error."""
    asked = written(asked, "conversations")
    none = F.lit(None).cast("string")
    failed = asked.where("error is not null").select("query_id", none.alias("route"), none.alias("standalone"), none.alias("answer"), "error")
    return engine.events(asked.where("error is null").select("query_id", "text", "history")).unionByName(answer.answer_events(failed))


@contextmanager
def data_batches_only(spark: SparkSession):
    """While a query starts, which keeps the settings of that moment: timers alone make no batch, else a run over what is available would never end."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def answer_stream(engine: Engine, questions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of questions (conversation_id, query_id, text, asked_at); each micro-batch writes its events as JSON lines to ``path/batch=N``."""

    def write(batch: DataFrame, n: int) -> None:
        found = events(engine, batch)
        found.sortWithinPartitions("query_id", "seq").select("query_id", "seq", "event").write.mode("overwrite").json(f"{path}/batch={n}")

    with data_batches_only(engine.spark):
        return with_history(questions).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
