import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import cells, search


def shown(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, one vector repeated a third of the time, unlike lengths and a few odd dimensions."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(25, 12)) * 3
    m = np.concatenate([middles[rng.integers(0, 25, 800)] + rng.normal(size=(800, 12)) * 0.2, np.repeat(middles[:1], 400, axis=0)])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(5000, None), (5001, [1.0, 2.0]), (5002, [2.0, 1.0]), (5003, [])]
    return spark.createDataFrame(rows, "id long, vec array<float>").repartition(5).persist()


@pytest.mark.parametrize("k, least", [(1, 0.0), (5, 2.0), (2000, -1e9)])
def test_same_rows_as_a_full_scan(spark, vectors, monkeypatch, k, least):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 40)
    monkeypatch.setattr(search, "CELLS", 3000)
    monkeypatch.setattr(cells, "PIECE", 100)
    asked = vectors.where("id % 20 = 0 or id > 5000").select(F.col("id").alias("query_id"), "vec")
    held = cells.celled(vectors, 30)
    got, skipped = cells.search_cells(held, asked, k, least)
    assert shown(got) == shown(search.dense_search(vectors, asked, k, least))
    assert skipped == 0 if k == 2000 else skipped > 0.5


def test_vectors_without_clusters_and_few_rows(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(60, 6)))], "id long, vec array<float>")
    q = v.where("id < 7").select(F.concat(F.lit("q"), "id").alias("query_id"), "vec")
    got, _ = cells.search_cells(cells.celled(v), q, 3, 0.1)
    assert shown(got) == shown(search.dense_search(v, q, 3, 0.1))
    none, skipped = cells.search_cells(cells.celled(v.limit(0)), q, 3, 0.1)
    assert none.count() == 0 and skipped == 0
