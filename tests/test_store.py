import time

import pytest

from colloquy.sources import store as stores
from colloquy.sources.store import Store
from colloquy.sources.transcripts import check_requests, read_directory, segments_to_lines
from colloquy.streaming.ingest import ingest, ingest_stream


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_ingest_is_idempotent_and_deletes_cascade(spark, tmp_path):
    put(tmp_path / "in", "2026-01-08-kick-off.txt", "Ann: hello there\nBo: yes please")
    put(tmp_path / "in", "b.VTT", "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nAnn: hi\n")
    put(tmp_path / "in", "bad.md", b"\xff\xfe\xff")
    put(tmp_path / "in", "skip.pdf", "no")
    files = read_directory(spark, str(tmp_path / "in"))
    assert {r.filename: r.error for r in files.collect()} == {"2026-01-08-kick-off.txt": None, "b.VTT": None, "bad.md": "file is not UTF-8"}
    store = Store(spark, str(tmp_path / "store"))
    ingest(store, files)
    ingest(store, files)
    m = store.meetings().collect()
    # an undated meeting is as new as its creation
    assert [(r.title, r.date, r.turn_count) for r in m] == [("B", None, 1), ("Kick off", "2026-01-08", 2)]
    assert store.table("turns").count() == 3 and store.table("chunks").count() == 2
    store.delete(store.table("meetings").where("title = 'B'").select("id"))
    assert store.table("turns").count() == 2 and store.table("chunks").count() == 1
    assert store.latest_traces() is None


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for k, text in enumerate(["Ann: one two", "Bo: three four", "Ann: one two"]):
        put(tmp_path / "in", f"f{k}.txt", text)
        ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(120)
    put(tmp_path / "in", "bad.txt", b"\xff\xfe\xff")
    ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), most=1).awaitTermination(120)
    assert store.table("meetings").count() == 2  # the third repeats the first
    assert [(r.filename, r.error) for r in store.table("rejected").collect()] == [("bad.txt", "file is not UTF-8")]


def test_requests(spark):
    df = spark.createDataFrame([("a.txt", "x", None, None), ("", "x", None, None), ("a", "", None, None), ("a", "x", "t" * 201, None)], "filename string, content string, title string, date string")
    assert [r.error for r in check_requests(df).collect()] == [None, "filename", "content", "title"]
    s = spark.createDataFrame([("m", 0, 3723000, None, "hi")], "id string, seq int, start_ms long, speaker string, text string")
    assert segments_to_lines(s).first().content == "[01:02:03] Speaker: hi"


def traces(spark, rows):
    return spark.createDataFrame([(f"t{i}", str(i), q, "{}") for i, q in rows], "trace_id string, created_at string, question string, payload string")


def held(store, name="traces"):
    t = store.table(name)
    return {} if t is None else {r.trace_id: r.question for r in t.collect()}


def test_rows_are_replaced_by_hiding_older_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save_traces(traces(spark, [(1, "a"), (2, "b")]))
    store.save_traces(traces(spark, [(2, "c"), (3, "d")]))
    first = {p.at for p in store.current()[1]["traces"]}
    store.save_traces(traces(spark, [(2, "e")]))
    assert held(store) == {"t1": "a", "t2": "e", "t3": "d"}
    assert first < {p.at for p in store.current()[1]["traces"]}  # nothing was written anew
    store.compact("traces")
    assert held(store) == {"t1": "a", "t2": "e", "t3": "d"} and len(store.current()[1]["traces"]) == 1
    store.save_traces(traces(spark, [(1, "f")]))
    assert held(store) == {"t1": "f", "t2": "e", "t3": "d"}


def test_many_commits_stay_bounded(spark, tmp_path, monkeypatch):
    """Reads, manifests and files don't grow with the commits; old snapshots go, what is left stays readable."""
    monkeypatch.setattr(stores, "MOST_PARTS", 4)
    monkeypatch.setattr(stores, "KEPT_VERSIONS", 3)
    store = Store(spark, str(tmp_path / "s"))
    for i in range(12):
        store.save_traces(traces(spark, [(i, "x"), (i // 2, "y")] if i else [(0, "x")]))
    assert held(store) == {f"t{i}": "y" if i < 6 else "x" for i in range(12)}
    version, parts = store.current()
    assert version == 12 and len(parts["traces"]) <= 6
    assert len(store.versions()) <= 4
    on_disk = len(list((tmp_path / "s" / "traces").iterdir()))
    assert on_disk <= 16 and len(list((tmp_path / "s" / "_claims").glob("v*"))) <= 4


def test_lookups_read_only_parts_that_may_hold_a_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(8):
        store.save_traces(traces(spark, [(10 * i + k, f"{i}") for k in range(10)]))
    parts = store.current()[1]["traces"]
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "trace_id string")
    assert len(store.holding(parts, ask("t35"), "trace_id")) == 1
    assert len(store.holding(parts, ask("t35", "t36", "t71"), "trace_id")) == 2
    assert len(store.holding(parts, ask("nowhere"), "trace_id")) == 0
    found = store.find("traces", ask("t35", "t71", "nowhere"))
    assert {r.trace_id: r.question for r in found.collect()} == {"t35": "3", "t71": "7"} and len(found.inputFiles()) <= 2 * 8
    assert store.find("traces", ask("nowhere")) is None
    fresh = store.new_only(traces(spark, [(35, "again"), (500, "new"), (500, "new")]), "traces")
    assert [r.trace_id for r in fresh.collect()] == ["t500"]


def test_key_filters_lose_no_key(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) as id")
    bits = stores.key_filter(keys, "id").persist()
    asked = spark.range(10_000, 60_000).selectExpr("cast(id as string) as id")
    one = lambda df: stores.may_hold(bits, df, "id").selectExpr("leaf", "bit").distinct()
    inside = asked.where("cast(id as int) < 20000")
    assert one(inside).count() == inside.select(stores._leaf(stores.F.col("id")), stores._bit(stores.F.col("id"))).distinct().count()
    outside = asked.where("cast(id as int) >= 20000")
    assert one(outside).count() < 0.01 * 40_000


def test_writers_lose_no_update(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: Store(spark, str(tmp_path / "s")).save_traces(traces(spark, [(i, "q")])), range(5)))
    assert sorted(held(Store(spark, str(tmp_path / "s")))) == [f"t{i}" for i in range(5)]


def test_a_killed_writer_holds_nothing_up(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.save_traces(traces(spark, [(1, "a")]))
    (tmp_path / "s" / "_claims" / "v2.0000").touch()  # claimed, and never finished
    monkeypatch.setattr(stores, "TRIES", 2)
    with pytest.raises(RuntimeError, match="lease"):
        store.save_traces(traces(spark, [(2, "b")]))
    monkeypatch.setattr(stores, "LEASE", 0.5)
    time.sleep(1)
    assert store.save_traces(traces(spark, [(2, "b")])) == 2
    assert held(store) == {"t1": "a", "t2": "b"}
    assert store._superseded(f"{tmp_path}/s/_claims/v2.0000")  # the late writer would notice
