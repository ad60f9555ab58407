import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import postings, rank, search

K1, B = 1.2, 0.75


def slow(docs, questions, k, scope=None):
    """BM25 over all texts, one by one; a term with a blank is a phrase."""
    n, avgdl = len(docs), sum(len(w) for _, _, w in docs) / len(docs)
    count = lambda w, p: sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))
    out = []
    for q, terms in questions:
        scores = Counter()
        for term, times in terms.items():
            tf = {i: c for i, _, w in docs if (c := count(w, term.split(" ")))}
            idf = max(math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
            for i, part, w in docs:
                if i in tf and (not scope or q not in scope or part in scope[q]):
                    scores[i] += times * idf * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * len(w) / avgdl))
        best = sorted(((round(s, 9), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, i, round(s, 6), r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    draw = lambda n: rng.choices(words, [1 / (i + 1) for i in range(200)], k=n)
    docs = [(i, f"m{i % 37}", draw(rng.choice((2, 20, 90)))) for i in range(500)] + [(900, "m1", []), (901, "m2", None)]
    questions = [(q, Counter(draw(rng.choice((1, 4, 12))))) for q in range(25)]
    questions += [(30, Counter({"w0 w1": 1, "w2": 2})), (31, Counter({"w0 w0": 1})), (32, Counter({"nowhere": 1, "w5 nowhere": 1}))]
    return docs, questions


def frames(spark, docs, questions):
    words = spark.createDataFrame([(i, p, i % 37 // 20, w) for i, p, w in docs], "id int, part string, slab int, w array<string>")
    terms = spark.createDataFrame([(q, t, n) for q, c in questions for t, n in c.items()], "query_id int, term string, times int")
    return words, terms


def shown(df):
    return sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_index_scores_as_a_loop_over_all_texts(spark, corpus, k):
    docs, questions = corpus
    words, terms = frames(spark, docs, questions)
    index = postings.blocks(words.repartition(5)).persist()
    n, avgdl = postings.statistics(index)
    plain = [(i, p, w or []) for i, p, w in docs]
    assert (n, avgdl) == (len(docs), sum(len(w) for *_, w in plain) / len(docs))
    held = postings.opened(index, terms).persist()
    assert shown(postings.best(held, terms, n, avgdl, k)) == slow(plain, questions, k)
    scope = {3: {"m1", "m5"}, 30: {"m2"}, 4: {"none"}}
    own = spark.createDataFrame([(q, p) for q, ps in scope.items() for p in ps], "query_id int, part string")
    assert shown(postings.best(held, terms, n, avgdl, k, own)) == slow(plain, questions, k, scope)
    assert postings.best(held.limit(0), terms, n, avgdl, k).count() == 0


def test_bounds_hold_and_skip(spark, corpus):
    """No text scores above its slab's bound, whatever the average length; for rare words most slabs stay shut."""
    docs, questions = corpus
    words, terms = frames(spark, docs, questions)
    index = postings.blocks(words).persist()
    held = postings.opened(index, terms).persist()
    n, _ = postings.statistics(index)
    part = {i: (p, i % 37 // 20) for i, p, _ in docs}
    for avgdl in (5.0, 40.0, 400.0):
        prices = postings.priced(held, terms, n).persist()
        bounds = postings.slab_bounds(held, prices, avgdl).persist()
        most = {(r.query_id, r.part, r.slab): r.most for r in bounds.collect()}
        scores = postings.slab_scores(held, prices, bounds, avgdl).collect()
        assert all(r.score <= most[(r.query_id, *part[r.id])] + 1e-6 for r in scores)
        floors = postings.top(spark.createDataFrame(scores), 3).where("rank = 3").select("query_id", F.col("score").alias("floor"))
        left = postings.remaining(bounds, floors)
        assert left.count() < 0.9 * len(most)


def test_search_reads_only_buckets_of_its_terms(spark, corpus, tmp_path):
    docs, questions = corpus
    words, terms = frames(spark, docs, questions)
    postings.blocks(words).write.partitionBy("bucket").parquet(str(tmp_path / "index"))
    few = terms.where("query_id = 0")
    stored = spark.read.parquet(str(tmp_path / "index"))
    opened = postings.opened(stored, few)
    asked = postings.buckets_of(few)
    assert 0 < len(asked) < postings.BUCKETS
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan)
    assert {r.term for r in opened.select("term").distinct().collect()} == {t for t in questions[0][1]}


def test_dense_search_in_parts(spark, monkeypatch):
    """More questions than a part holds, and slices smaller than a batch: the same rows, and it ends."""
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[10] = m[11]
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(999, None), (998, [1.0])], "id int, vec array<float>").repartition(4)
    q = v.where("id < 300").select(F.col("id").alias("query_id"), "vec")
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(search, "CELLS", 50)
    got = sorted((r.query_id, r.id, r["rank"]) for r in search.dense_search(v, q, 3, 0.5).collect())
    s = np.round(m.astype(float) @ m.astype(float).T, 9)
    want = []
    for i in range(300):
        best = sorted((-s[i, j], j) for j in range(300) if s[i, j] >= 0.5)[:3]
        want += [(i, j, r) for r, (_, j) in enumerate(best, 1)]
    assert got == sorted(want)


def plain_mmr(rows, limit, lam):
    """rows in order: (id, fused, vec, affinity)."""
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    left, taken = list(rows), []
    while left and len(taken) < limit:
        value = lambda r: round(lam * (0.7 * ((r[1] - low) / ((high - low) or 1)) + 0.3 * r[3]) - (1 - lam) * max([0.0, *(sum(x * y for x, y in zip(r[2], t[2])) for t in taken)]), 12)  # noqa: E731,B023
        taken.append(left.pop(max(range(len(left)), key=lambda i: (value(left[i]), -i))))
    return [r[0] for r in taken]


def test_mmr_is_the_plain_loop(spark):
    """Opposite vectors earn nothing."""
    rng = random.Random(1)
    rows = {"x": [("A", 1.0, [1.0, 0.0], 0.0), ("B", 0.2, [-1.0, 0.0], 0.0), ("C", 0.6, [0.0, 1.0], 0.0)]}
    for q in range(20):
        rows[str(q)] = [(f"c{i:02}", rng.random(), [rng.uniform(-1, 1) for _ in range(3)], rng.uniform(-1, 1)) for i in range(rng.choice((1, 2, 9)))]
    df = spark.createDataFrame([(q, r[0], k, *r[1:]) for q, rs in rows.items() for k, r in enumerate(rs, 1)], "query_id string, id string, place int, fused double, vec array<double>, affinity double")
    got = {}
    for r in rank.mmr_select(df, 4, 0.7).orderBy("turn").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: plain_mmr(rs, 4, 0.7) for q, rs in rows.items()}
    assert got["x"] == ["A", "C", "B"]
