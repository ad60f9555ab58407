import random
import time

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chunk


def slow(costs, target, overlap):
    out, s = [], 0
    for i in range(len(costs)):
        if i > s and sum(costs[s : i + 1]) > target:
            out.append((s, i - 1))
            k = s
            while k < i and sum(costs[k:i]) > overlap:
                k += 1
            s = i if k == s else k
    return [*out, (s, len(costs) - 1)]


@pytest.mark.parametrize("target, overlap", [(30, 8), (30, 0), (30, -1), (5, 30), (1, 0)])
def test_both_ways_are_the_loop(spark, target, overlap):
    rng = random.Random(target)
    meetings = {i: [rng.choice((0, 1, 2, 5, 9, 40)) for _ in range(rng.choice((1, 2, 30, 90)))] for i in range(40)}
    turns = spark.createDataFrame([(i, n, c) for i, cs in meetings.items() for n, c in enumerate(cs)], "id int, n int, cost long").repartition(4)
    want = sorted((i, o, a, b) for i, cs in meetings.items() for o, (a, b) in enumerate(slow(cs, target, overlap)))
    assert sorted(map(tuple, chunk.folded_windows(turns, target, overlap).collect())) == want
    assert sorted(map(tuple, chunk.jumped_windows(turns, target, overlap).collect())) == want


def test_long_meetings_jump(spark, monkeypatch):
    monkeypatch.setattr(chunk, "FOLDED", 50)
    rng = random.Random(0)
    meetings = {i: [rng.choice((1, 2, 5, 9)) for _ in range(n)] for i, n in enumerate((10, 50, 51, 400))}
    turns = spark.createDataFrame([(i, n, c) for i, cs in meetings.items() for n, c in enumerate(cs)], "id int, n int, cost long")
    want = sorted((i, o, a, b) for i, cs in meetings.items() for o, (a, b) in enumerate(slow(cs, 40, 10)))
    assert sorted(map(tuple, chunk.chunk_windows(turns, 40, 10).collect())) == want


def test_a_meeting_of_half_a_million_turns(spark):
    """Ten times the turns take about ten times as long at most; the fold would take a hundred times."""
    turns = lambda n: spark.range(n).select(F.lit("m").alias("id"), F.col("id").cast("int").alias("n"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("cost"))
    took = {}
    for n in (50_000, 500_000):
        began = time.time()
        windows = chunk.chunk_windows(turns(n), 320, 60)
        ends = windows.agg(F.count("*").alias("c"), F.max("last").alias("last"), F.max("ordinal").alias("o"), F.sum((F.col("last") < F.col("first")).cast("int")).alias("bad")).first()
        took[n] = time.time() - began
        assert ends.last == n - 1 and ends.o == ends.c - 1 and not ends.bad and n / 12 < ends.c < n / 3
    assert took[500_000] < 15 * took[50_000] + 10
