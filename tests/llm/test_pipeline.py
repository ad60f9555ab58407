import hashlib

import corpus_pipeline
import public_tokenizers as P
from tokenizers import Tokenizer

from colloquy.llm.quality import quality_report
from colloquy.llm.simhash import shingle_hashes
from tests.llm.test_decontam import slow as slow_contaminated
from tests.llm.test_line_dedup import slow as slow_lines


def test_run_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.kept}
    texts = [(d, rows[d].text, rows[d].source) for d in sorted(kept)]
    from colloquy.llm.line_dedup import MIN_SITES

    left = [(d, t) for (d, old, _), (_, t) in zip(texts, slow_lines(texts, MIN_SITES)) if t.strip() or not old.strip()]
    sets, group = [set(shingle_hashes(t.encode(), 5).tolist()) for _, t in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for k, g in enumerate(group):
        first.setdefault(g, k)  # in order of id
    left = [left[k] for k in sorted(first.values())]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in slow_contaminated(left, bench)}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))) for d, t in left if d not in bad for ids in [lib.encode(t, add_special_tokens=False).ids]]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(want)
    assert 0 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf_dir)
        assert odd.columns == docs.columns


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    long = spark.createDataFrame([(900, "word and more " * 80_000, "en", "s", 1_120_000), (None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    names = ["_i", "_k", "_n", "_s", "_drop", "_n_lines", "id", "k", "h", "r", "left", "n_removed", "_own", "_host"]
    odd = docs.union(long).selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf_dir)
        assert odd.columns == docs.columns + names
        assert [r[5:] for r in odd.limit(1).collect()] == [tuple(range(len(names)))]
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_last_stage_of_an_empty_table(spark, sf_dir):
    odd = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf_dir).count() == 0
