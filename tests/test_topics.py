from colloquy.operators import brief


def test_topics_of_ids_that_rows_share(spark):
    rows = [(1, "beta alpha beta\n[00:01] Ann: gamma alpha"), (2, "delta"), (2, "echo delta echo delta delta"), (None, "foxtrot golf"), (None, "golf"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.term, r.n, r.place) for r in brief.topics(df, 2).collect()}
    assert got == {(1, "beta", 2, 1), (1, "alpha", 2, 2), (2, "delta", 4, 1), (2, "echo", 2, 2), (None, "golf", 2, 1), (None, "foxtrot", 1, 2)}
    plan = brief.topics(df.where("id = 1"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
