import json

import pytest
from pyspark.sql import functions as F

from colloquy.engine import Engine
from colloquy.streaming import answers

KIND = "conversation_id string, query_id string, text string, asked_at timestamp"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("answers") / "store"))
    e.ingest(spark.createDataFrame([("2026-01-15-a.txt", "Ann: We chose Postgres for the ledger because of transactions.\nBo: Fine with me."), ("b.txt", "Cy: The gateway certificate expired on Monday.")], "filename string, content string"))
    return e


def shown(rows):
    """Events without the ids that differ from run to run."""
    out = []
    for r in rows:
        e = json.loads(r.event)
        if isinstance(e["data"], dict):
            e["data"].pop("traceId", None)
        out.append((r.query_id, r.seq, json.dumps(e, sort_keys=True)))
    return sorted(out)


def test_stream_and_batch_give_the_same_events(spark, engine, tmp_path):
    batches = [
        [("c1", "q1", "Tell me about the Postgres ledger", 10), ("c2", "q2", "What happened to the gateway certificate?", 11)],
        [("c1", "q4", "why did they choose it?", 40), ("c2", "q5", "", 41)],
        [("c1", "q3", "who agreed to that?", 30), ("c1", "q6", "and it?", 60)],  # q3 arrives after q4
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "conversation_id string, query_id string, text string, at int")
        df.select("conversation_id", "query_id", "text", F.timestamp_seconds("at").alias("asked_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        answers.answer_stream(engine, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = shown(spark.read.json(str(tmp_path / "out")).collect())
    whole = spark.read.schema(KIND).parquet(str(tmp_path / "in"))
    # a question that came late doesn't stand in the history of one that was answered before
    want = answers.with_history(whole).withColumn("history", F.when(F.col("query_id") == "q4", F.slice("history", 1, 1)).otherwise(F.col("history")))
    assert got == shown(answers.events(engine, want).collect())
    assert {q for q, *_ in got} == {"q1", "q2", "q3", "q4", "q5", "q6"}
    assert any("postgres" in e.lower() and '"meta"' in e for q, _, e in got if q == "q4")  # the history made the question stand alone


def test_too_late_and_long_conversations(spark, tmp_path):
    asked = [[(f"q{i}", i) for i in range(10, 40)], [("q0", 0), ("q24b", 24), ("q30b", 30)]]
    found = {}
    for rows in asked:
        df = spark.createDataFrame([("c", q, f"text {q}", at) for q, at in rows], "conversation_id string, query_id string, text string, at int")
        df.select("conversation_id", "query_id", "text", F.timestamp_seconds("at").alias("asked_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = answers.with_history(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")))
        with answers.data_batches_only(spark):
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: found.update({r.query_id: r for r in b.collect()})).trigger(availableNow=True).start()
        query.awaitTermination(120)
    past = {q: [t.content for t in r.history] for q, r in found.items()}
    assert past["q10"] == [] and past["q11"] == ["text q10"] and past["q39"] == [f"text q{i}" for i in range(33, 39)]
    assert past["q30b"] == [f"text q{i}" for i in range(25, 31)] and found["q30b"].error is None
    assert found["q0"].error == found["q24b"].error == answers.LATE and set(found) == {q for rows in asked for q, _ in rows}
