"""Line dedup by distinct-site spread.

A line is boilerplate if it stands on MIN_SITES sites or more. HyperLogLog sketches of the sites, one per line hash, merge by
aggregation, so a line on every page costs one sketch a task. Estimates within NEAR of the
threshold are settled by exact distinct counts; others are far beyond the sketch's error. The first occurrence of a boilerplate
line in (id, position) order stays, later ones go: a text that sites copied from each other
is kept once rather than lost. DataFrame functions only.

Lines are compared without their outer ASCII white space by 64- and 32-bit hashes together; blank lines are never boilerplate.

Cases: a null text has no line and stays null; a null site is a site of its own (the empty name); null ids come last
in the order; rows of equal id and text are treated alike, and of equal ids the text of least key counts as first; a very long text is
one row of as many lines as it has, and a line of any length is hashed whole; extra columns pass through ``remove_boilerplate`` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import let, lookup, materialise, packed, row_key

MIN_SITES = 10
#: Relative width of the band of exact counts; a sketch of 2^12 registers errs by 1.6 % (one standard deviation).
NEAR, SKETCH = 0.25, 12
BLANK = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, k, site, pos, h, c): the non-blank lines; k stands for the row's text."""
    split = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("k"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    line = F.btrim("line", F.lit(BLANK))
    return split.select("id", "k", "site", "pos", line.alias("line")).where("line <> ''").select("id", "k", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("c"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h, c, first): lines on ``min_sites`` sites or more with their first occurrence, materialised."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "k", "pos")
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h", "c").agg(F.hll_sketch_agg("site", SKETCH).alias("sketch"), F.min(order).alias("first"))
    spread = materialise(spread.select("h", "c", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h", "c")
    exact = lookup(lines.select("h", "c", "site"), near, ["h", "c"], "inner").groupBy("h", "c", "site").agg(F.lit(1).alias("one")).groupBy("h", "c").agg(F.count("*").alias("exact"))
    return materialise(spread.join(exact, ["h", "c"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h", "c", "first"), "boilerplate")


def _without(lines, drop):
    """``lines`` less the positions ``drop``: few are searched, many meet their lines in one sort."""
    searched = lambda d: F.filter(lines, lambda _, i: ~F.array_contains(d, i))
    mark = lambda d: F.concat(F.transform(d, lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"), F.lit("").alias("line"))), F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x.alias("line"))))
    stay = lambda s: F.filter(s, lambda x, j: (x["kind"] == 1) & ((j == 0) | F.coalesce(F.get(s, j - 1)["i"] != x["i"], F.lit(True))))
    merged = lambda d: F.transform(let(F.array_sort(mark(d)), stay), lambda x: x["line"])
    return F.when(F.size(drop) <= 64, searched(drop)).otherwise(merged(drop))


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(r, id, left, n_lines, n_removed): each row of ``docs`` as a struct, its text less the boilerplate, and its non-blank lines, all and removed."""
    known = boilerplate(docs, id_col, text_col, site_col, min_sites)
    here = F.struct(F.col("id").isNull().alias("last"), "id", "k", "pos")
    later = lookup(_lines(docs, id_col, text_col, site_col), known, ["h", "c"], "inner").where(~here.eqNullSafe(F.col("first")))
    drop = materialise(later.groupBy("id", "k").agg(F.array_sort(F.collect_set("pos")).alias("drop")).withColumnsRenamed({"id": "_i", "k": "_k"}), "drop")
    joined = packed(docs, id_col, text_col).join(drop, F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k")), "left")
    text = F.col("r")[text_col]
    split = F.split(text, "\n", -1)
    words = F.filter(split, lambda x: F.btrim(x, F.lit(BLANK)) != "")
    left = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(_without(split, F.col("drop")), "\n"))
    return joined.select("r", "id", left.alias("left"), F.greatest(F.coalesce(F.size(words), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("long").alias("n_removed"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text_col`` less its boilerplate lines."""
    cut = cut_lines(docs, id_col, text_col, site_col, min_sites)
    return cut.select(*[(F.col("left") if c == text_col else F.col("r")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of ``docs``: the id, its lines, those removed, and what is left."""
    left = F.coalesce("left", F.lit(""))
    cut = cut_lines(docs.select(id_col, text_col, site_col), id_col, text_col, site_col, min_sites)
    return cut.select(F.col("id").alias(id_col), "n_lines", "n_removed", F.length(left).cast("long").alias("n_chars"), F.sha2(left, 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), words AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines
), known AS (
  SELECT bare, min(struct_pack(d := doc_id, p := pos)) AS first FROM words WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}
), kept AS (
  SELECT w.*, k.bare IS NOT NULL AND struct_pack(d := doc_id, p := pos) <> k.first AS gone FROM words w LEFT JOIN known k ON w.bare = k.bare
), texts AS (
  SELECT doc_id, sum(CASE WHEN bare <> '' THEN 1 ELSE 0 END) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""
