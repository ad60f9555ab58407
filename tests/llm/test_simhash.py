import numpy as np
import xxhash

from colloquy.llm import simhash
from colloquy.llm.simhash import fingerprint, near_links, simhash_components


def slow_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(rows, radius=2):
    fps = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(rows, fps, group)), key=str)


def test_components_match_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base.replace(f" w{i} ", f" z{i} ")) for i in range(1, 40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "one"), (54, "ONE"), (54, "ONE"), (None, "two words"), (55, "É x y z"), (56, "é x y z"), (57, "a " * 3000)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(df).collect()), key=str)
    assert got == slow_components(rows)


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert got == slow_components(rows)


def test_large_bucket_is_dealt_as_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 12, 60).astype(np.uint64), rng.integers(0, 1 << 62, 30).astype(np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for agree in (1, 2, 3):
        held(fps, near_links(nodes, 2, agree).collect())


def held(fps, links):
    part = {int(x): int(x) for x in fps}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for r in links:
        assert bin(r.u ^ r.v).count("1") <= 2
        part[top(r.u)] = top(r.v)
    for a in fps.tolist():
        for b in fps.tolist():
            if bin(a ^ b).count("1") <= 2:
                assert top(a) == top(b)


def test_fingerprint():
    for t in ("", "a", "a b", "A b C d", "x\x1fy z w", "ÀÉ b c d e"):
        assert fingerprint(t.encode()) == slow_print(t)


def test_keep_first(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (7, base), (3, base + " x"), (None, base), (None, "alone here"), (9, "other words"), (9, "other words"), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in simhash.keep_first(df).collect())))
    assert got == sorted(map(str, [(3, base + " x"), (None, "alone here"), (9, "other words"), (11, None)]))
