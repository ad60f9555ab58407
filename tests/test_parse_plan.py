from colloquy.operators import parse


def test_turns_of_one_layout_plan_that_layout_only(spark):
    """All layouts were planned for every table, in one stage: 25 sorts, windows and joins a task."""
    df = spark.createDataFrame([(1, "[00:00:01] Ann: hi\nmore\n[00:00:03] Bob: yes")], "id long, content string")
    plan = parse.parse_turns(df)
    assert [(r.speaker, r.text) for r in plan.orderBy("index").collect()] == [("Ann", "hi more"), ("Bob", "yes")]
    shown = plan._jdf.queryExecution().sparkPlan().toString()
    assert sum(shown.count(x) for x in ("Window ", "SortMergeJoin", "HashAggregate", "SortAggregate")) <= 4
    assert parse.parse_turns(df.limit(0)).count() == 0
