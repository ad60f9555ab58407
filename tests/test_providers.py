import os

import pytest
from pyspark.sql import functions as F

from colloquy.operators import providers, search


class Flaky:
    """Fails every other call, answers out of order and leaves one request out; notes what it was asked."""

    name, kind = "flaky", "string"

    def __init__(self, notes):
        self.notes = notes

    def call(self, requests):
        assert len(requests) <= providers.BATCH
        path = os.path.join(self.notes, str(os.getpid()))
        n = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if n % 2 == 0:
            raise ConnectionError("try again")
        with open(os.path.join(self.notes, "asked"), "a") as f:
            f.writelines(f"{r}\n" for r in requests)
        out = [(i, r.upper()) for i, r in enumerate(requests) if r != "never"]
        return out[::-1] if len(out) < 2 else out[1:][::-1]


def test_a_failing_provider_gives_the_same_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(providers, "PAUSE", 0.0)
    monkeypatch.setattr(providers, "TRIES", 12)
    monkeypatch.setattr(providers, "BATCH", 7)
    (tmp_path / "notes").mkdir()
    p = Flaky(str(tmp_path / "notes"))
    rows = [(i, f"text {i % 20}") for i in range(60)] + [(100, None), (101, ""), (102, "never")]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "'mine' as key").repartition(3)
    got = {r.id: r for r in providers.replies(df, p, str(tmp_path / "replies")).collect()}
    assert set(got) == {i for i, _ in rows} and all(r.key == "mine" for r in got.values())
    assert all(got[i].reply == f"TEXT {i % 20}" and got[i].error is None for i in range(60))
    assert got[100].reply == got[101].reply == "" and got[102].reply is None and got[102].error == "no reply" or got[102].error == "try again"
    before = (tmp_path / "notes" / "asked").read_text()
    again = {r.id: r.reply for r in providers.replies(df.where("id < 60"), p, str(tmp_path / "replies")).collect()}
    assert again == {i: f"TEXT {i % 20}" for i in range(60)}
    assert (tmp_path / "notes" / "asked").read_text() == before  # nothing was asked twice


def test_offline_provider_is_the_hashed_embedding(spark, sf_dir, tmp_path):
    texts = ["don't stop the Émigré-run; it's 42!", "", "a the of", "日本語 テキスト ok", "x\x1fy tab\there\x0bthere"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 40").select(F.col("doc_id") + 100, "text"))
    got = {r.id: r.reply for r in providers.replies(docs, providers.HashedEmbeddings(), str(tmp_path / "r")).collect()}
    want = {r.id: r.vec for r in search.hash_vectors(docs).collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        assert got[i] == pytest.approx(v, abs=1e-6), i
