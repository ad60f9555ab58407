import duckdb

from colloquy.llm.line_dedup import ORACLE, line_report, remove_boilerplate


def test_matches_sql(spark, sf_dir):
    for sf in (sf_dir, "/root/testdata/sf0.01"):
        got = sorted(tuple(r) for r in line_report(spark.read.parquet(f"{sf}/documents.parquet")).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        assert got == sorted(con.execute(ORACLE).fetchall())
    assert any(r[2] for r in got)


def slow(rows, min_sites):
    lines = [(d is None, d or 0, i, p, s or "", x.strip(" \t\n\x0b\f\r")) for i, (d, t, s) in enumerate(rows) for p, x in enumerate((t or "").split("\n"))]
    sites, first = {}, {}
    for last, d, i, p, s, x in lines:
        if x:
            sites.setdefault(x, set()).add(s)
            first[x] = min(first.get(x, (True, 1 << 60, 0, 0)), (last, d, i, p))
    out = []
    for i, (d, t, _) in enumerate(rows):
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not (b := x.strip(" \t\n\x0b\f\r")) or len(sites[b]) < min_sites or first[b] == (d is None, d or 0, i, p))
        out.append((d, kept))
    return out


def test_odd_rows(spark):
    rows = [(i, f"own {i}\n menu \n\nown {i}\nmenu", f"s{i % 4}") for i in range(1, 9)]
    rows += [(None, "menu\nlast", None), (20, None, "s1"), (21, "", "s1"), (22, "\n".join(["menu"] * 200 + ["end"]), "s2"), (23, "three\nthree", "s1"), (24, "three", "s2"), (25, "three", "s3")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, h long, line string")
    got = remove_boilerplate(df, min_sites=4).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(slow(rows, 4), key=str)
    assert {r.h for r in got} == {7}


def test_near_threshold_is_exact(spark):
    rows = [(i, f"line {n}", f"site {i}") for n in (199, 200, 201, 150, 260) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("monotonically_increasing_id() as doc_id", "text", "source")
    left = {r.text: r["count"] for r in remove_boilerplate(df, min_sites=200).groupBy("text").count().collect()}
    assert left["line 199"] == 199 and left["line 150"] == 150 and left["line 200"] == 1 and left["line 201"] == 1 and left["line 260"] == 1


def test_empty(spark):
    assert line_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
