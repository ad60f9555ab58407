import hashlib
import random

import numpy as np

from colloquy.llm import suffix_dedup as s
from colloquy.llm.suffix_dedup import cut_report, cut_texts, runs, window_factors


def slow(rows, n=50):
    first = {}
    texts = [(1 << 63 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(d, first.get(w, d))
    out = []
    for (d, _), (o, b) in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < o:
                gone[i : i + n] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in cut_report(cut_texts(df)).collect()), key=str)


def test_previous_factors_match_plain_loops():
    rng = np.random.default_rng(0)
    for n, letters, orders in ((1, 2, 2), (60, 2, 5), (300, 2, 40), (300, 1, 3), (200, 3, 1)):
        text = rng.integers(97, 97 + letters, n + 60).astype(np.uint8)
        starts = rng.permutation(n)
        order = rng.integers(0, orders, n)
        want = []
        for p, o in zip(starts, order):
            shared = [0]
            for q, r in zip(starts, order):
                if r < o:
                    differs = np.flatnonzero(text[p : p + 50] != text[q : q + 50])
                    shared.append(int(differs[0]) if len(differs) else 50)
            want.append(max(shared))
        assert window_factors(text, starts, order).tolist() == want


def test_minimizers_of_many_runs_are_split(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(s, "HOT", 3)
    monkeypatch.setattr(s, "SPLIT", 40)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    made = [(1000 + i, "".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) + "the same sixteen bytes and some more, " + rng.choice(["one ", "two "]) * 12) for i in range(40)]
    docs = docs.union(spark.createDataFrame(made, docs.schema))
    assert got(docs.repartition(5)) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_ids_of_other_types(spark):
    rows = [("b", "x" * 60), ("a", "x" * 70), (None, "x" * 50), ("c", "y"), ("a", "x" * 70)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert [(r.doc_id, r.n_removed) for r in cut_texts(df).orderBy("doc_id", "n_bytes").collect()] == [(None, 50), ("a", 0), ("a", 0), ("b", 60), ("c", 0)]


def test_equal_windows_have_equal_minimizers(monkeypatch):
    rng = random.Random(1)
    piece = bytes(rng.choices(b"ab ", k=300))
    texts = [bytes(rng.choices(b"abcd ", k=rng.randint(0, 90))) + piece + bytes(rng.choices(b"xy", k=70)) for _ in range(5)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for place in (26, 8):  # the latter cuts the texts into short parts
        monkeypatch.setattr(s, "_PLACE", place)
        h, first, count, text = runs(data, offsets)
        assert count.sum() == sum(max(0, len(t) - 49) for t in texts)
        if place == 26:
            of = {}
            for m, a, c in zip(h.tolist(), first.tolist(), count.tolist()):
                for p in range(a, a + c):
                    assert of.setdefault(data[p : p + 50].tobytes(), m) == m


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(docs.repartition(5)) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["ab", "é", "the ", "x", "\n", "\x00", "日本"]
    piece = ["".join(rng.choices(vocab, k=60)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(piece)[rng.randint(0, 20) :] if rng.random() < 0.5 else "".join(rng.choices(vocab, k=30)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(None, piece[0] * 3), (None, piece[0] * 3), (7, rows[3][1]), (7, piece[1] * 5), (7, piece[1] * 5), (80, None), (81, ""), (82, "z" * 500), (83, "z" * 500), (-5, "q" * 49), (-4, "q" * 49), (-3, "q" * 50), (-2, "q" * 51)]
    df = spark.createDataFrame([(*r, "u") for r in rows], "doc_id long, text string, k string").repartition(7)
    assert got(df) == slow(rows)


def test_empty(spark):
    assert cut_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
