"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.operators import evaluate
from colloquy.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda x: round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted(names), sorted((tuple(shown(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1] or name == "mmr_select"
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_mmr_select_asks_every_twentieth_vector(spark):
    at = "/root/testdata/sf0.01"
    ids = {r.vec_id for r in spark.read.parquet(f"{at}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query_id for r in QUERIES["mmr_select"](spark, at).collect()} == ids and max(ids) >= 20


def test_latency_shares_follow_no_order_of_rows(spark):
    """In doubles the total is 1.0400000000000005 or more in either order, and the share 12."""
    values = [0.13, *[0.01] * 91]
    for own in (values, values[::-1]):
        rows = spark.createDataFrame([(1, x) for x in own] + [(2, math.inf), (2, 1.0), (3, None)], "trace_id long, ms double").coalesce(1)
        got = evaluate.latency_share(rows, ["trace_id"]).collect()
        assert {r.share for r in got if r.trace_id == 1 and r.ms == 0.13} == {13}
        assert [r.share for r in got if r.trace_id == 2 and r.ms == 1.0] == [2]


def test_latency_shares_are_those_of_the_sql_at_half_percents(spark, tmp_path):
    """0.13 of these 92 events is 12.5 percent by exact sums, and less by the sum of doubles in the order of the file that the SQL takes."""
    at = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, i // 92 AS user_id, CASE WHEN i % 92 = 0 THEN 0.13::DOUBLE WHEN i = 100 THEN NULL ELSE 0.01::DOUBLE END AS value FROM range(184) t(i)) TO '{at}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}'")
    want = con.execute(ORACLES["stage_latency_share"]).fetchall()
    assert (0, 12) in want
    assert sorted(tuple(r) for r in QUERIES["stage_latency_share"](spark, str(tmp_path)).collect()) == sorted(want)
    rows = spark.read.parquet(at).orderBy(F.desc("event_id")).selectExpr("event_id", "user_id", "value as ms").coalesce(1)
    got = evaluate.latency_share(rows, ["user_id"], ["event_id"])
    assert got.columns == ["event_id", "user_id", "ms", "share"] and {(r.event_id, r.share) for r in got.collect() if r.share} == set(want)
