import math

import numpy as np

from colloquy.llm.quality import fit_heads, keep_good, quality_report


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_rejects_junk_and_toxic_texts_and_keeps_others(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    # half the labels are held out
    got = quality_report(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    junk = [not r.kept for r in got if r.quality == 0]
    toxic = [not r.kept for r in got if r.toxic == 1]
    print(len(good), np.mean(good), len(junk), np.mean(junk), len(toxic), np.mean(toxic))
    assert np.mean(good) > 0.98 and np.mean(junk) > 0.95 and np.mean(toxic) > 0.9


def test_matches_brute_force(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    docs = docs.union(docs.limit(5)).union(docs.limit(3).selectExpr("null", "text", "lang", "null", "n_chars")).union(docs.limit(2).selectExpr("doc_id", "null", "null", "source", "n_chars"))
    docs = docs.selectExpr("*", "1 as n", "'x' as own")
    heads = fit_heads(docs, labels)
    rows = docs.collect()
    own = [float(heads.log_odds([r.text or ""])[0]) for r in rows]
    p = [1 / (1 + math.exp(-x)) for x in own]
    report = quality_report(docs, labels).collect()
    assert sorted(round(x, 6) for x in own) == sorted(r.own_log_odds for r in report)
    # sites by hand, given the prior strengths that a site of one text shows
    hosts, paths = {}, {}
    for r, x in zip(rows, p):
        for d, k in ((hosts, r.source or ""), (paths, (r.source or "", r.lang or ""))):
            n, s = d.get(k, (0, 0.0))
            d[k] = (n + 1, s + x)
    mu = sum(p) / len(p)
    spread = sum(n * (s / n - mu) ** 2 for n, s in hosts.values())
    inner = sum(n * (s / n - hosts[k[0]][1] / hosts[k[0]][0]) ** 2 for k, (n, s) in paths.items())
    strength = lambda v, k: min(1e4, max(1.0, mu * (1 - mu) / max(1e-6, (v - k * mu * (1 - mu)) / len(p)) - 1))
    a, b = strength(spread, len(hosts)), strength(inner, len(paths))
    logit = lambda x: math.log(x / (1 - x))
    want = []
    for r, x, o in zip(rows, p, own):
        n, s = hosts[r.source or ""]
        host = (s - x + a * mu) / (n - 1 + a)
        n, s = paths[r.source or "", r.lang or ""]
        want.append(o + logit((s - x + b * host) / (n - 1 + b)) - logit(mu))
    assert np.allclose(sorted(want), sorted(r.log_odds for r in report), atol=1e-3)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in report)


def test_empty_and_unlabelled(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    assert quality_report(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels.limit(0)).count() == docs.count()
