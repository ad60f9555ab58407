import itertools

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import ngram_join as J
from colloquy.llm.common import materialise, row_key
from colloquy.llm.near_copies import signed, shared_prefixes
from colloquy.llm.simhash import shingle_hashes


def slow(rows, width=3):
    """(id, set size, least id reachable), by comparing all pairs."""
    sets = [set(shingle_hashes((t or "").encode(), width).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if not x or not y or 10 * min(len(x), len(y)) < 9 * max(len(x), len(y)):
            continue
        both = len(x & y)
        if 100 * both >= 90 * (len(x) + len(y) - both):
            links += 1
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least.get(g)) for g, (i, _), s in zip(group, rows, sets)), key=str), links


def edited(seed=5):
    """Families of texts on both sides of 0.9: some edits, some longer by words at an end."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(10):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(90, 260)))]
        for edits in (0, 1, 2, 3, 4, 5, 6):
            new = list(words)
            for at in rng.choice(len(new), edits, replace=False):
                new[at] = f"z{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(new)))
            rows.append((len(rows), " ".join(new + [f"e{x}" for x in range(int(rng.integers(1, 14)))])))
    return rows


def test_hashes_tell_word_sequences_apart():
    texts = ["a b c d", "A  b\tc d", "a b", "b a", "a", "a b c", "b c a", "é É x", "", " \n"]
    h = [J.ngram_hashes(t.encode(), 3).tolist() for t in texts]
    assert h[0] == h[1] and len(h[0]) == 2 and h[0][0] == h[5][0] and h[8] == h[9] == []
    assert len({x for y in h for x in y}) == 7
    many = J.ngram_hashes(" ".join(f"w{i % 211}x{i % 97}" for i in range(20_000)).encode(), 3)
    assert len(set(many.tolist())) == len({tuple(f"w{j % 211}x{j % 97}" for j in (i, i + 1, i + 2)) for i in range(19_998)})


def test_links_on_both_sides_of_the_bound(spark):
    rows = edited()
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "one two"), (903, "ONE two"), (903, "ONE two"), (904, "x y z"), (905, "X  y\tz"), (906, "\n"), (None, "only nulls here"), (907, "é É"), (908, "é é")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want, links = slow(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 100 < links < 2000 and len({r[2] for r in want}) > 20


def test_product_counts_prefix_overlaps(spark):
    """Without roots every pair of like size appears with the overlap of its prefixes, if parity bits allow; no similar pair falls below its bound."""
    rows = edited(8)[:70]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("k", row_key()).select("id", "k", "text")
    nodes = materialise(signed(texts, 3, J.SIMILAR).dropDuplicates(["s"]), "nodes")
    got = {}
    for r in J.product(shared_prefixes(nodes), nodes, spark.createDataFrame([], "s long, root long"), J.SIMILAR).collect():
        got[r.u, r.v] = got.get((r.u, r.v), 0) + r.c
    held = {r.s: (r.n, set(np.frombuffer(r.lead, np.int64).tolist())) for r in nodes.collect()}
    whole = {r.s: set(shingle_hashes(dict(rows)[r.id].encode(), 3).tolist()) for r in nodes.collect()}
    similar = 0
    for u, v in itertools.combinations(sorted(held), 2):
        (n, x), (m, y) = held[u], held[v]
        if (u, v) in got:
            assert got[u, v] == len(x & y)
        both = len(whole[u] & whole[v])
        if 10 * both >= 9 * (n + m - both):
            similar += 1
            assert got[u, v] >= J.least_overlap(np.array([n]), np.array([m]), J.SIMILAR)[0]
    assert similar > 50
    kept = {tuple(r) for r in J.overlapping(spark.createDataFrame([(u, v, held[u][0], held[v][0], c) for (u, v), c in got.items()], "u long, v long, n long, m long, c long"), J.SIMILAR).collect()}
    assert similar <= len(kept) < len(got)


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """A shared passage with a word changed in each copy: lists longer than a tile, one component."""
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "SUMMED", 64)
    base = [f"p{x}" for x in range(120)]
    rows = [(i, " ".join([*base[: i % 60], f"c{i}", *base[i % 60 + 1 :]])) for i in range(70)]
    rows += [(100 + i, " ".join([*base, *(f"t{i}x{k}" for k in range(40))])) for i in range(40)]  # the passage alone doesn't link
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
                     .collect()), key=str)
    assert got == slow(rows)[0]


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, J.jaccard_components(docs).collect()), key=str)
    assert got == slow([tuple(r) for r in docs.collect()])[0]
    assert J.jaccard_components(docs.where(F.lit(False))).count() == 0
