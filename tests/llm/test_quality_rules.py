import re

import numpy as np

from colloquy.llm import quality_rules as q
from colloquy.llm.quality_rules import quality_rules, text_statistics

WS = re.compile(r"[\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = [w for w in WS.split(text) if w]
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    texts = [None, "", " \n\x0b", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "né#*$ %&|<> é b c", "a b c d " * 200, "one two three\x1ffour " * 40, " lead and trail \n"]
    texts += [" ".join(f"w{(i * i) % 61}" for i in range(n)) for n in (10, 100, 400)] + [" ".join(f"w{i % 300}" for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_statistics(df).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}


chosen = set()  # the starts whose ends were of least determinant


def slow_verdicts(rows):
    """rows: (id, g, vector); the concentration steps one group at a time."""
    out = {}
    quantile = lambda v, share: sorted(v)[max(0, int(np.ceil(share * len(v))) - 1)]
    floors = np.array(list(q.FLOORS.values()), float)
    for g in {r[1] for r in rows}:
        ids = [r[0] for r in rows if r[1] == g]
        x = np.array([r[2] for r in rows if r[1] == g], float)
        dist = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)  # noqa: B023, E731
        moments = lambda keep: (x[keep].mean(0), q.CONSISTENT * np.cov(x[keep].T, bias=True) + np.diag(floors**2), keep.sum())  # noqa: B023, E731

        def nearest(mean, cov, share):
            bins = np.floor(q.BINS * np.log2(1 + dist(mean, cov)))  # noqa: B023
            return moments(bins <= quantile(bins, share))  # noqa: B023

        middle = np.array([quantile(c, 0.5) for c in x.T])
        first = (middle, np.diag(np.maximum([1.4826 * quantile(c, 0.5) for c in abs(x - middle).T], floors) ** 2), len(x))
        ends = []
        for start, now in enumerate((first, nearest(*first[:2], 0.5), moments(np.ones(len(x), bool)))):
            for _ in range(q.STEPS):
                now = nearest(*now[:2], q.KEEP)
            ends.append((round(np.log(np.diag(np.linalg.cholesky(now[1]))).sum(), q.DIGITS), start, now))
        mean, cov, n = min(ends, key=lambda e: e[:2])[2]
        chosen.add(min(ends, key=lambda e: e[:2])[1])
        out |= {i: (None if n < q.KEEP * q.MIN_GROUP else d) for i, d in zip(ids, dist(mean, cov))}
    return out


def test_verdicts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.selectExpr("doc_id + 1000", "text", "null", "source", "n_chars")).union(docs.limit(3)).withColumn("g", q.F.lit(1))
    got = quality_rules(docs).collect()
    stats = q.grouped(text_statistics(docs.drop("g")).where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")).select("doc_id", "g", *q.vector()).collect()
    want = slow_verdicts([(r[0], r[1], list(r[2:])) for r in stats])
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.doc_id not in want)
        if not r.base_failed:
            assert r.kept == (want[r.doc_id] is None or want[r.doc_id] <= q.CUTOFF)
            assert (r.distance2 is None) == (want[r.doc_id] is None) and (r.distance2 is None or abs(r.distance2 - want[r.doc_id]) < 1e-3)


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cur = con.execute(q.oracle())
    df = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert [d[0] for d in cur.description] == df.columns
    want = sorted(cur.fetchall())
    got = sorted(tuple(r) for r in df.collect())
    assert [r[:8] for r in got] == [r[:8] for r in want]
    assert all(a[8] == b[8] for a, b in zip(got, want))
