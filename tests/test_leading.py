import numpy as np

from colloquy.operators import search
from colloquy.operators.leading import Leading


def test_running_best_is_bounded():
    rng = np.random.default_rng(3)
    all_ = np.round(rng.random((6, 4000)), 2)
    lead, most = Leading(6, 5, 0.2, 50), 0
    for a in range(0, 4000, 40):
        lead.add(np.arange(a, a + 40), all_[:, a : a + 40])
        most = max(most, lead.held)
    assert most <= 2 * 5 * 6 + 50 + 6 * 40
    rows = lead.rows(np.arange(6))
    for q in range(6):
        want = sorted((-s, i) for i, s in enumerate(all_[q].tolist()) if s >= 0.2)[:5]
        assert [(-r.score, r.id) for r in rows[rows.query_id == q].itertuples()] == want


def test_grams_are_hashed_by_few_texts(spark, monkeypatch):
    """A whole Arrow batch of texts was hashed at once."""
    sizes = []
    monkeypatch.setattr(search, "TEXTS", 3)
    monkeypatch.setattr(search, "_cells", lambda lists, dimensions, real=search._cells: (sizes.append(len(lists)), real(lists, dimensions))[1])
    assert len(search.embed_texts(["a"])) == 1 and sizes == [1]
    df = spark.createDataFrame([(i, f"word{i} other") for i in range(10)], "id long, text string").coalesce(1)
    work = search.hash_embed(df)
    assert work.select("id").distinct().count() == 10 and work.groupBy("id").count().agg({"count": "max"}).first()[0] <= 3


def test_rough_scores_rule_out_none_of_the_best():
    """Scores off by less than the slack pick the cells; ties and the order of near scores are those of the exact ones."""
    rng = np.random.default_rng(5)
    exact = np.round(0.5 + 1e-6 * rng.integers(0, 400, (6, 3000)), 9)
    rough, slack = exact + rng.uniform(-0.9e-4, 0.9e-4, exact.shape), np.full(6, 1e-4)
    lead, seen = Leading(6, 5, 0.2, 0), 0
    for a in range(0, 3000, 150):
        at, where = lead.candidates(rough[:, a : a + 150], slack)
        seen += len(at)
        lead.put(at, np.arange(a, a + 150)[where], exact[at, a + where])
    rows = lead.rows(np.arange(6))
    for q in range(6):
        want = sorted((-s, i) for i, s in enumerate(exact[q].tolist()))[:5]
        assert [(-r.score, r.id) for r in rows[rows.query_id == q].itertuples()] == want
    assert seen < exact.size


def test_dense_search_tells_near_scores_apart(spark):
    """Scores that floats don't tell apart, lengths far from one, and vectors out of the range of floats' products."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(64).astype(np.float32)
    vecs = [(base + np.float32(1e-4) * rng.standard_normal(64)).astype(np.float32) * np.float32(s) for s in [1.0] * 300 + [40.0] * 20] + [np.full(64, 1e30, np.float32)]
    asked = [base, base * np.float32(30), -base]
    found = search.dense_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<float>").repartition(2), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<float>"), 24, 0.05)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()}
    for q, a in enumerate(asked):
        scores = [round(float(a.astype(float) @ v.astype(float)), 9) for v in vecs]
        want = sorted((-s, i) for i, s in enumerate(scores) if s >= 0.05)[:24]
        assert [got[q, n][0] for n in range(1, len(want) + 1)] == [i for _, i in want] and (q, len(want) + 1) not in got
