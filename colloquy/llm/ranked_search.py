"""Ranked lexical search: the k best documents of every item, by a join whose thresholds the index seeds.

The index keeps, per term, its weight, its greatest impact and its k best postings. The kth impact of a term is a score that k
documents reach at least, so the greatest of them over an item's terms bounds the item's kth score from below; the exact scores of the stored postings'
documents raise that bound. With an item's terms in order of their greatest contribution, those whose sum stays below the bound are pruned:
a document that holds no other term can't be among the k best. Postings of the terms left meet the items, which gives candidates; a
candidate whose sum, with all that the pruned terms could add, misses the bound goes. The rest are scored exactly, over all their terms.

Documents are read once, into rows that hold their terms of the asked vocabulary with counts, so postings of a document stay together and candidate sums
need no shuffle. Items are asked in blocks whose terms fit the broadcast bound; every block reads all documents.

Cases: a null or empty text has no terms, and such an item gets no row; very long texts are taken whole, terms of any length; each row of the items and of the
documents counts by itself, so repeated item rows get equal rankings and repeated documents each a rank; equal scores rank by
ascending id, null ids last, then by any order; terms that no document holds add nothing; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_BYTES, ascii_lower, bound_batches, giving_back, lookup, materialise, raw

#: A term: digits, Latin letters and all beyond ASCII; over lower-cased UTF-8 bytes, and as Java's pattern.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of an item's ranking, and products of postings with items that one step of a task holds.
BEST, STEP = 10, 1 << 21


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, q) per row and term of ``items``; ``item`` numbers the rows."""
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    words = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM_SQL), F.lit(0)))
    return asked.select("item", "item_id", words.alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("q"))


def forward_rows(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, terms, tfs) per document with a term: n counts all its terms, the arrays those of the vocabulary by their places in it."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for b in batches:
            n, sizes, terms, tfs = [], [], [], []
            for t in raw(b.column(2)):
                words = TERM.findall(t.lower())
                n.append(len(words))
                held = [(p, c) for w, c in Counter(words).items() if (p := places.get(w)) is not None]
                sizes.append(len(held))
                terms += [p for p, _ in held]
                tfs += [c for _, c in held]
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            rows = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *lists], ["row", "id", "n", "terms", "tfs"])
            yield rows.filter(pa.array(np.array(n, np.int64) > 0))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return numbered.mapInArrow(giving_back(work), f"row long, id {kind}, n long, terms array<int>, tfs array<int>")


def length_factor(total: int, words: int):
    """A document's m."""
    return F.lit(100 - 75).cast("long") + F.expr(f"(75L * n * {total}L) div {max(words, 1)}L")


def _postings(b: pa.RecordBatch, weights: np.ndarray, total: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the document in the batch, term, impact) of every posting of a batch of forward rows (row, n, terms, tfs)."""
    sizes = np.diff(b.column(2).offsets.to_numpy())
    terms, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(b.num_rows), sizes)
    m = (100 - 75) + (75 * b.column(1).to_numpy() * total) // max(words, 1)
    return at, terms, weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))


def stored_peaks(forward: DataFrame, weights: np.ndarray, total: int, words: int, k: int) -> DataFrame:
    """(term, place, row, impact): the k postings of greatest impact of each term; a task keeps its own k best, their union gives the k best of all."""
    sent = forward.sparkSession.sparkContext.broadcast(weights)

    def best(term: np.ndarray, row: np.ndarray, impact: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((row, -impact, term))
        term, row, impact = term[order], row[order], impact[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
        place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
        return [x[place < k] for x in (term, row, impact)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in batches:
            at, term, impact = _postings(b, sent.value, total, words)
            kept = best(*(np.concatenate(x) for x in zip(kept, best(term, b.column(0).to_numpy()[at], impact))))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["term", "row", "impact"])

    peaks = forward.select("row", "n", "terms", "tfs").mapInArrow(giving_back(work), "term int, row long, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    return peaks.withColumn("place", place).where(F.col("place") <= k)


def candidates(forward: DataFrame, held: pa.Table, floors: pa.Table, weights: np.ndarray, total: int, words: int) -> DataFrame:
    """(item, row): documents whose postings of an item's unpruned terms, with ``slack`` for the pruned ones, reach the item's floor.

    held: (term, item, q) of unpruned terms; floors: (item, floor, slack). Both are bounded by the block of items.
    """
    order = np.argsort(held["term"].to_numpy(), kind="stable")
    ids = floors["item"].to_numpy()
    place = np.argsort(ids, kind="stable")
    term = held["term"].to_numpy()[order]
    starts = np.searchsorted(term, np.arange(len(weights) + 1))
    item = np.searchsorted(ids[place], held["item"].to_numpy()[order])
    sent = forward.sparkSession.sparkContext.broadcast((starts, item, held["q"].to_numpy()[order], ids[place], (floors["floor"].to_numpy() - floors["slack"].to_numpy())[place], weights))

    def met(at: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, item, q, ids, least, _ = sent.value
        n = (starts[1:] - starts[:-1])[term]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = np.repeat(starts[term], n) + within
        key, slot = np.unique(np.repeat(at, n) * len(ids) + item[where], return_inverse=True)
        score = np.zeros(len(key), np.int64)
        np.add.at(score, slot, np.repeat(impact, n) * q[where])
        ok = score >= least[key % len(ids)]
        return key[ok] // len(ids), ids[key[ok] % len(ids)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, *_, weights = sent.value
        for b in batches:
            at, term, impact = _postings(b, weights, total, words)
            wanted = starts[term] < starts[term + 1]
            at, term, impact = at[wanted], term[wanted], impact[wanted]
            # whole documents a step: their products with the items stay bounded
            made = np.cumsum((starts[1:] - starts[:-1])[term])
            last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.empty(0, np.int64)
            x = 0
            while x < len(at):
                full = int(np.searchsorted(made[last], (made[x - 1] if x else 0) + STEP, "right"))
                y = int(last[max(full - 1, int(np.searchsorted(last, x)))]) + 1
                doc, item = met(at[x:y], term[x:y], impact[x:y])
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(b.column(0).to_numpy()[doc])], ["item", "row"])
                x = y

    return forward.select("row", "n", "terms", "tfs").mapInArrow(giving_back(work), "item long, row long")


def exact_scores(pairs: DataFrame, forward: DataFrame, wanted: DataFrame, total: int, words: int) -> DataFrame:
    """(item, row, id, score) of every (item, row) of ``pairs``, over all terms. wanted: (item, term, q, w)."""
    rows = lookup(forward, pairs, ["row"], "inner").select("item", "row", "id", length_factor(total, words).alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    terms = lookup(rows.select("item", "row", "id", "m", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf")), wanted, ["item", "term"], "inner")
    return terms.groupBy("item", "row", "id").agg(F.sum(F.expr("q * w * ((1000000000L * tf) div (1000L * tf + 8L * m))")).alias("score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above zero of every row of ``items``."""
    bound_batches(docs.sparkSession)
    asked = materialise(item_terms(items, item_id, item_text), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + F.lit(64)), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // BROADCAST_BYTES))
    found = [_ranked_block(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    return reduce(DataFrame.union, found).select("item_id", "rank", F.col("id").alias(id_col), "score")


def _ranked_block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(r.term for r in asked.select("term").distinct().collect())  # bounded by the block
    places = spark.createDataFrame(pa.table({"term": pa.array(range(len(vocabulary)), pa.int32()), "word": pa.array(vocabulary, pa.string())}))
    forward = materialise(forward_rows(docs, vocabulary, id_col, text_col), "forward")
    total, words = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = materialise(df.withColumn("w", F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1)))), "term-stats")
    weights = np.zeros(len(vocabulary), np.int64)
    held = stats.select("term", "w").toArrow()
    weights[held["term"].to_numpy()] = held["w"].to_numpy()
    peaks = materialise(stored_peaks(forward, weights, total, words, k), "peaks")
    top = peaks.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth"))
    wanted = asked.withColumnRenamed("term", "word").join(places, "word").join(stats, "term").join(top, "term")
    wanted = materialise(wanted.select("item", "item_id", "term", "q", "w", (F.col("q") * F.col("most")).alias("most"), F.coalesce(F.col("q") * F.col("kth"), F.lit(0)).alias("kth")), "wanted")
    few = wanted.select("item", "term", "q", "w")
    # the kth impacts bound an item's kth score, the exact scores of the postings behind them bound it better
    seeds = materialise(few.join(peaks.select("term", "row"), "term").select("item", "row").distinct(), "seeds")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row"))
    seeded = exact_scores(seeds, forward, few, total, words).withColumn("place", place).where(F.col("place") == k).select("item", "score")
    floors = wanted.groupBy("item").agg(F.max("kth").alias("kth")).join(seeded, "item", "left").select("item", F.greatest("kth", F.coalesce("score", F.lit(0))).alias("floor"))
    upto = F.sum("most").over(Window.partitionBy("item").orderBy("most", "term"))
    bounds = materialise(wanted.select("item", "term", "q", "most", upto.alias("upto")).join(floors, "item").withColumn("pruned", F.col("upto") < F.col("floor")), "bounds")
    slack = bounds.groupBy("item").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(F.col("pruned"), F.col("most"))), F.lit(0)).alias("slack"))
    met = materialise(candidates(forward, bounds.where(~F.col("pruned")).select("term", "item", "q").toArrow(), slack.toArrow(), weights, total, words), "candidates")
    scores = exact_scores(met, forward, few, total, words).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= k)
    return lookup(best, materialise(asked.select("item", "item_id").distinct(), "asked"), ["item"], "inner").select("item_id", "rank", "id", "score")


ORACLE = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM sizes),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * total + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, total),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // words))) AS impact FROM postings JOIN weights USING (term) JOIN sizes USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(q * impact)::BIGINT AS score FROM (SELECT item_id, term, count(*) AS q FROM asked GROUP BY item_id, term) JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
