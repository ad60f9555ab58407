from pathlib import Path

import numpy as np

from colloquy.llm import near_copies
from colloquy.llm.simhash import shingle_hashes


def slow(rows, width=5):
    sets = [set(shingle_hashes((t or "").encode(), width).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            both, y = len(x & sets[j]), sets[j]
            if both * 5 >= 4 * (len(x) + len(y) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        first.setdefault(group[k], rows[k])
    return sorted(map(str, first.values()))


def test_similarity_of_four_fifths_is_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 3, 4, 5, 9):  # five shingles an edit: similarities on both sides of 0.8
            new = list(words)
            for at in rng.choice(200, edits, replace=False):
                new[at] = "z"
            rows.append((len(rows), " ".join(new)))
    rows += [(None, rows[0][1]), (200, None), (201, ""), (202, "one two"), (203, "ONE two"), (203, "ONE two"), (204, "x y z"), (204, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in near_copies.keep_first(df.repartition(5)).collect())
    assert got == slow(rows)
    assert 20 < len(got) < 60


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(str(tuple(r)) for r in near_copies.keep_first(docs).collect())
    assert got == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_stage_removes_near_copies_that_fingerprints_miss(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")  # two pairs of 0.8 and more, at 7 and 11 bits
    left = corpus_pipeline.near_dedup_stage(spark, docs, sf_dir)
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_tables_go_when_no_step_reads_them(spark, sf_dir, monkeypatch):
    import corpus_pipeline
    from colloquy.llm.common import materialise, work_dir

    top = Path(work_dir(spark).removeprefix("file:"), "colloquy")
    old, seen = set(top.glob("*")), []

    def there():
        return sorted(p.name.rsplit("-", 1)[0] for p in set(top.glob("*")) - old)

    def noted(df, label):
        out = materialise(df, label)
        seen.append((label, there()))
        return out

    monkeypatch.setattr(near_copies, "materialise", noted)
    left = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert not {"signed", "prefixed", "lead", "nodes", "rooted", "close", "sets", "similar"} & set(there()) and "first" in there()
    assert [label for label, _ in seen if label in ("sets", "rooted")] == ["sets", "rooted", "sets"]
    for label, held in seen:
        assert held.count("sets") == (label == "sets" or label == "similar")  # whole sets are held for one verification
        assert "signed" not in held and ("prefixed" in held) == (label in ("prefixed", "lead", "nodes"))  # prefixes are written once
    assert left.count() > 0

    before = set(top.glob("*"))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    stages = [p.name.rsplit("-", 1)[0] for p in set(top.glob("*")) - before]
    assert "benchmark-decontamination" in stages and not {"scored", "quality-classifier", "line-dedup", "SimHash-near-dedup", "first"} & set(stages)
