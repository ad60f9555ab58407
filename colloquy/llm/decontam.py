"""Benchmark decontamination by spaced-seed hashing.

A mask picks some positions of a short run of tokens and ignores the others. Hashes of the picked tokens, one per mask and start, join
training texts with benchmark items, so runs that differ by substitutions in ignored positions still meet. A hit
fixes an alignment; there, tokens are compared position by position, and the item is found in the text if some window of WINDOW
tokens (or the whole item, where shorter) agrees in SHARE of them. The three masks meet every placement of up to
WINDOW * (1 - SHARE) substitutions, so the hashes lose no such window. DataFrame functions only.

Tokens are runs of letters and digits, lower-cased; windows under 8 tokens must agree in full, and items shorter than every mask are
met by a mask of their own length that picks all their tokens.

Seeds of the benchmark are broadcast up to a size in bytes. Beyond it, a table of at most CELLS hash cells is, which drops most
positions of the texts before the rest are shuffled.

Cases: null texts and items have no token and match nothing; null or repeated ids keep their own rows' results, rows of equal id and text giving one, and
so do items of equal id; very long texts are met whole, with hits in lists of HITS at most; of windows that match equally well none is preferred, as only
their size and matches are told; extra columns are ignored by ``contaminated`` and pass through ``remove_contaminated`` whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_BYTES, lookup, materialise, packed, row_key, table_bytes

#: Offsets that each mask picks.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
WINDOW, SHARE, EXACT_BELOW = 20, 0.8, 8
#: Items of fewer tokens have a mask of their own.
SHORT = 5
#: Hash cells of the benchmark's seeds, and hits of a text that are verified together.
CELLS, HITS = 1 << 21, 1000


def needed(window):
    """Tokens that must agree in a window of so many."""
    return F.when(window < EXACT_BELOW, window).otherwise(F.ceil(window * SHARE)).cast("int")


def _tokens(text_col: str):
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(words, lambda x: F.xxhash64(x))


def _seeds(h, mask: tuple[int, ...], m: int):
    """Hash of the tokens that mask number ``m`` picks, for each start in the token array ``h``."""
    span = mask[-1] + 1
    each = lambda i: F.xxhash64(F.lit(m), *[F.get(h, i + k) for k in mask])
    return F.when(F.size(h) < span, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - span), each))


def _positions(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """keep, n, seed and its index ``at`` in the seeds of all masks one after another; rows hold the token array h."""
    seeds = F.concat(*[_seeds(F.col("h"), mask, m) for m, mask in enumerate(masks)])
    return rows.select(*keep, F.size("h").alias("n"), F.posexplode(seeds).alias("at", "seed"))


def _start(at, n, m, masks: list[tuple[int, ...]]):
    """The start in the text of seed ``at``: less the seeds of the masks before ``m``."""
    before, out = F.lit(0), None
    for k, mask in enumerate(masks):
        out = F.when(m == k, at - before) if out is None else out.when(m == k, at - before)
        before = before + F.greatest(n - mask[-1], F.lit(0))
    return out


def _met(positions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Positions of the texts joined with the benchmark's seeds."""
    if table_bytes(seeds) <= BROADCAST_BYTES:
        return positions.join(F.broadcast(seeds), "seed")
    cell = F.pmod("seed", F.lit(CELLS)).alias("cell")
    cells = materialise(seeds.select(cell).distinct(), "cells")  # CELLS rows at most
    return positions.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi").drop("cell").join(seeds, "seed")


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, row key, item, window, matched): one row per text and benchmark item found in it, with its best window."""
    items = materialise(bench.select(F.col(item_col).alias("item"), row_key(item_text).alias("key"), _tokens(item_text).alias("h")).where("size(h) > 0").distinct(), "items")
    short = sorted(r.n for r in items.where(F.size("h") < SHORT).select(F.size("h").alias("n")).distinct().collect())  # SHORT - 1 numbers at most
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    spans = F.array(*[F.lit(mask[-1]) for mask in masks])
    seeds = _positions(items, ["item", "key"], masks).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
    seeds = seeds.withColumn("j", _start(F.col("at"), F.col("n"), F.col("m"), masks)).where((F.col("j") >= 0) & (F.col("j") < F.col("n") - F.get(spans, "m")))
    own = (F.col("m") < len(MASKS)) | (F.col("n") == F.get(spans, "m") + 1)  # a short item's mask is for items of its length
    seeds = materialise(seeds.where(own).select("seed", "m", "item", "key", "j", F.col("n").alias("len")), "seeds")
    texts = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("k"), _tokens(text_col).alias("h"))
    hits = _met(_positions(texts, ["id", "k"], masks), seeds).withColumn("diag", _start(F.col("at"), F.col("n"), F.col("m"), masks) - F.col("j"))
    hits = hits.groupBy("id", "k", "item", "key", "len", "diag").agg(F.lit(1).alias("one"))
    hits = hits.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("id", "k").orderBy("item", "key", "diag")) - 1) / HITS))
    hits = hits.groupBy("id", "k", "part").agg(F.collect_list(F.struct("item", "key", "len", "diag")).alias("hits"))
    hits = materialise(hits.withColumnsRenamed({"id": "_i", "k": "_k"}), "hits")
    slim = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    met = slim.join(hits, F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k"))).select("id", "k", _tokens("text").alias("h"), "hits")
    # each alignment's stretch of the text, filled up with nulls where the item goes beyond it
    piece = lambda x: F.concat(F.array_repeat(F.lit(None).cast("bigint"), F.greatest(-x["diag"], F.lit(0))), F.slice("h", F.greatest(x["diag"], F.lit(0)) + 1, x["len"]))
    cut = met.select("id", "k", F.explode(F.transform("hits", lambda x: F.struct(x["item"].alias("item"), x["key"].alias("key"), piece(x).alias("piece")))).alias("x")).select("id", "k", "x.*")
    same = lookup(cut.withColumnRenamed("item", "_item"), items, ["key"], "inner").where(F.col("item").eqNullSafe(F.col("_item")))
    same = same.select("id", "k", "item", F.transform("h", lambda x, i: F.when(F.get("piece", i) == x, 1).otherwise(0)).alias("eq")).withColumn("window", F.least(F.size("eq"), F.lit(WINDOW)))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("eq") - F.col("window")), lambda i: F.aggregate(F.slice("eq", i + 1, F.col("window")), F.lit(0), lambda a, b: a + b)))
    found = same.withColumn("matched", best).where(F.col("matched") >= needed(F.col("window")))
    return found.groupBy("id", "k", "item").agg(F.max("window").cast("long").alias("window"), F.max("matched").cast("long").alias("matched"))


def contamination_report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, window, matched): one row per document and item found in it."""
    return contaminated(docs, bench).groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("window").alias("window"), F.max("matched").alias("matched"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the texts in which a benchmark item was found."""
    found = materialise(contaminated(docs, bench, id_col, text_col).select(F.col("id").alias("_i"), F.col("k").alias("_k")).distinct(), "found")
    return packed(docs, id_col, text_col).join(found, F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k")), "left_anti").select("r.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark
), dt AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d
), bt AS (
  SELECT item_id, len(w) AS n, least(len(w), {WINDOW}) AS win, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM b
), same AS (
  SELECT doc_id, item_id, win, p - j AS diag, j FROM dt JOIN bt USING (t)
), dense AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diag) AS c FROM same
  QUALIFY c >= CASE WHEN win < {EXACT_BELOW} THEN win ELSE ceil(win * {SHARE}) END
), runs AS (
  SELECT a.doc_id, a.item_id, a.win, a.diag, a.j, count(*) AS matched FROM dense a JOIN dense z
    ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND a.diag = z.diag AND z.j BETWEEN a.j AND a.j + a.win - 1
  GROUP BY ALL
)
SELECT doc_id, item_id, CAST(max(win) AS BIGINT) AS "window", CAST(max(matched) AS BIGINT) AS matched FROM runs
WHERE matched >= CASE WHEN win < {EXACT_BELOW} THEN win ELSE ceil(win * {SHARE}) END GROUP BY doc_id, item_id
"""
