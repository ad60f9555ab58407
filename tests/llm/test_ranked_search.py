import math
import random
import re
from collections import Counter

import duckdb
import pytest

from colloquy.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def slow(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for at, (i, c, n) in enumerate(held):
            m = 25 + 75 * n * total // words
            s = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i, at))
        out += [(item, rank, i, -s) for rank, (s, _, i, _) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_odd_texts_and_ties(spark):
    docs = [(1, "Alpha beta"), (2, "beta ALPHA"), (3, None), (4, ""), (5, "-- !"), (6, "é É ñandú9 beta"), (7, "x" * 100_000 + " alpha"), (2, "beta ALPHA"), (None, "alpha beta"), (8, "gamma " * 500)]
    items = [(1, "alpha, beta."), (2, None), (3, "!"), (4, "nowhere"), (5, "gamma GAMMA Ñandú9 ñandú9 é"), (1, "alpha, beta."), (None, "beta")]
    got = R.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as term", "2 as n"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as item", "4 as q"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, items)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.ranked_search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert R.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [1, 3, 10])
def test_pruning_loses_nothing(spark, monkeypatch, k):
    """Skewed words, documents of very different length, several blocks of items and many steps a batch."""
    monkeypatch.setattr(R, "BROADCAST_BYTES", 8_000)
    monkeypatch.setattr(R, "STEP", 300)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, draw(rng.choice((3, 30, 300)))) for i in range(400)]
    items = [(i, draw(rng.choice((1, 5, 25)))) for i in range(30)] + [(100, docs[7][1]), (101, docs[8][1])]
    got = R.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, items, k)


def test_thresholds_prune(spark, sf_dir, monkeypatch):
    """On the tables most pairs that share a term are never scored."""
    made = {}
    plain = R.candidates
    monkeypatch.setattr(R, "candidates", lambda *a: made.setdefault("met", plain(*a)))
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, R.ranked_search(docs, items).collect()))
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    assert got == sorted(duckdb.sql(R.ORACLE).fetchall())
    asked = [set(terms(r.text)) for r in items.collect()]
    sharing = sum(bool(a & set(terms(r.text))) for r in docs.collect() for a in asked)
    assert len(got) <= made["met"].count() < sharing / 2
