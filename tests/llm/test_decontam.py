import itertools
import math
import random
import re

import duckdb

from colloquy.llm import decontam
from colloquy.llm.decontam import EXACT_BELOW, MASKS, ORACLE, SHARE, WINDOW, contaminated, contamination_report, remove_contaminated


def test_masks_meet_every_tolerated_window():
    for n in range(5, WINDOW + 1):
        allowed = n - (n if n < EXACT_BELOW else math.ceil(n * SHARE))
        for bad in itertools.combinations(range(n), allowed):
            assert any(i + m[-1] < n and not {i + k for k in m} & set(bad) for m in MASKS for i in range(n)), (n, bad)


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in contamination_report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert got == sorted(con.execute(ORACLE).fetchall()) and got


def words(t):
    return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]


def slow(docs, bench):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, s in bench:
            b = words(s)
            if not b:
                continue
            win = min(len(b), WINDOW)
            need = win if win < EXACT_BELOW else math.ceil(win * SHARE)
            for diag in range(-len(b), len(w)):
                eq = [int(0 <= diag + j < len(w) and w[diag + j] == b[j]) for j in range(len(b))]
                if max(sum(eq[j : j + win]) for j in range(len(b) - win + 1)) >= need:
                    out.add((d, i))
    return out


def test_odd_rows(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(50)]
    bench = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([4, 5, 7, 9, 12, 20, 25, 40, 3, 2])] + [(50, None), (51, ""), (5, "same id other text of words here"), (None, "null item text with seven words here")]
    docs = [(None, bench[6][1]), (1, None), (2, ""), (2, bench[5][1] + "!"), (2, bench[5][1] + "!"), (60, "null ITEM text, with seven; words here?")]
    for d in range(100, 160):
        text = rng.choices(vocab, k=rng.randint(0, 60))
        item = words(rng.choice(bench[:8])[1])
        item = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]) else x for x in item]
        at = rng.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + item + text[at:])))
    dd = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, n int")
    bb = spark.createDataFrame([(*r, "y") for r in bench], "item_id long, text string, h string")
    want = slow(docs, bench)
    assert {(r.id, r.item) for r in contaminated(dd, bb).collect()} == want
    bad = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in remove_contaminated(dd, bb).collect()) == sorted(str(d) for d, t in docs if (d, t) not in {(d, t) for d, t in docs if d in bad and slow([(d, t)], bench)})


def test_large_seed_tables_are_joined_by_shuffle(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in contamination_report(docs, bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontam, "HITS", 2)
    assert sorted(tuple(r) for r in contamination_report(docs, bench).collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert contamination_report(none, some).count() == 0
    assert contamination_report(some.withColumnRenamed("item_id", "doc_id"), some.limit(0)).count() == 0
