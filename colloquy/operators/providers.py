"""Embeddings and replies from a provider behind one seam: batches, replies by index, retries, and a table of replies so that nothing is asked twice.

Requests are distinct by the provider's name and their text. Those whose reply is stored aren't sent; the others go out from the tasks in batches of BATCH, and a batch whose call
fails, or leaves a request without a reply, is asked again for what is missing. What comes back is written before it is used, so a later step or a lost
executor asks nothing again. A request that keeps failing gets an error in its row and is asked again by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.search import DIMENSIONS, embed_texts
from colloquy.sources.scratch import files_of, written

#: Requests of a call, calls for one batch, and seconds before the second call, doubled each time.
BATCH, TRIES, PAUSE = 96, 4, 0.5


class Provider(Protocol):
    """``call`` gets requests and gives (index, reply) pairs in any order; ``kind`` is the SQL type of a reply."""

    name: str
    kind: str

    def call(self, requests: list[str]) -> list[tuple[int, Any]]: ...


class HashedEmbeddings:
    """The provider without a network: hashed words and word pairs."""

    name, kind = "hashed-ngrams", "array<float>"

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def call(self, requests: list[str]) -> list[tuple[int, Any]]:
        return list(enumerate(embed_texts(requests, self.dimensions)))


def _batch(provider: Provider, requests: list[str]) -> tuple[list, list]:
    """Replies and errors of a batch, by place."""
    replies: list = [None] * len(requests)
    errors: list = ["no reply"] * len(requests)
    open_ = list(range(len(requests)))
    for k in range(TRIES):
        if k:
            time.sleep(PAUSE * 2 ** (k - 1))
        try:
            for at, reply in provider.call([requests[i] for i in open_]):
                replies[open_[at]], errors[open_[at]] = reply, None
        except Exception as e:
            for i in open_:
                errors[i] = errors[i] and (str(e) or type(e).__name__)
        open_ = [i for i in open_ if errors[i]]
        if not open_:
            break
    return replies, errors


def replies(requests: DataFrame, provider: Provider, path: str, text_col: str = "text") -> DataFrame:
    """``requests`` with reply and error. path: the folder of stored replies, which this call adds to."""
    spark = requests.sparkSession
    key = F.sha2(F.concat_ws("\n", F.lit(provider.name), F.coalesce(text_col, F.lit(""))), 256)
    keyed = written(requests.select(F.struct("*").alias("r"), key.alias("key"), F.coalesce(text_col, F.lit("")).alias("request")), "requests")
    shape = f"key string, reply {provider.kind}"
    load = lambda: spark.read.schema(shape).parquet(path) if files_of(spark, path) else spark.createDataFrame([], shape)
    new = keyed.select("key", "request").dropDuplicates(["key"]).join(load().select("key"), "key", "left_anti")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BATCH):
                part = f.iloc[a : a + BATCH]
                got, errors = _batch(provider, part["request"].tolist())
                yield pd.DataFrame({"key": part["key"].tolist(), "reply": got, "error": errors})

    asked = written(new.mapInPandas(work, f"{shape}, error string"), "replies")
    asked.where("error is null").select("key", "reply").write.mode("append").parquet(path)
    failed = asked.where("error is not null").select("key", "error")
    return keyed.join(load().dropDuplicates(["key"]), "key", "left").join(failed, "key", "left").select("r.*", "reply", "error")
