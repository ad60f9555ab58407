"""An inverted index as a table, and BM25 over it that skips blocks.

A row of the index is a block: the postings of one term within one slab of chunks, in order of their ids, with the greatest frequency and
the least length in it. Every slab is cut at the same chunks for all terms, so what a slab's blocks can add to a question bounds the score of each chunk
of it, whatever the averages have become since it was written. A search takes the slabs of greatest bound first; the kth score found there
rules out all slabs whose bound stays below it, and only the blocks of the others are opened.

Blocks lie in buckets by a hash of their term, the folders of a stored index: a search reads those of its terms. Positions serve phrases: their words' blocks
of one slab meet in a join, and what comes of it are blocks again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Buckets of terms, chunks of a slab, slabs that a question opens first, and what a bound may be short of by rounding.
BUCKETS, SLAB, FIRST, EPSILON = 32, 64, 4, 1e-6


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def by_hash(words: DataFrame, n: int) -> DataFrame:
    """(part, slab, id, w): texts without an order of their own, dealt by id into slabs of about SLAB."""
    return words.select(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // SLAB)))).alias("part"), F.lit(0).alias("slab"), "id", "w")


def blocks(words: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(part, slab, bucket, term, n, most_tf, least_dl, entries): entries hold (id, dl, tf, at). words: part, slab, id and the words w of each text.

    terms: for an index that serves these terms only, with their words.

    Texts are dealt once, by slab; what follows needs no further shuffle. Under the empty term every text has a posting, so the index holds its own statistics.
    """
    w = F.coalesce("w", F.array().cast("array<string>"))
    each = words.repartition("part", "slab").select("part", "slab", "id", F.size(w).alias("dl"), F.posexplode(F.array_append(w, F.lit(""))).alias("pos", "term"))
    if terms is not None:
        each = each.join(terms.select(F.explode(F.split("term", " ")).alias("term")).union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
    one = each.groupBy("part", "slab", "term", "id", "dl").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return _blocks(one)


def _blocks(one: DataFrame) -> DataFrame:
    """Blocks of postings (part, slab, term, id, dl, at)."""
    entry = F.struct("id", F.col("dl").cast("int").alias("dl"), F.size("at").alias("tf"), F.col("at").cast("array<int>").alias("at"))
    rows = one.groupBy("part", "slab", "term").agg(F.count("*").cast("int").alias("n"), F.max(F.size("at")).alias("most_tf"), F.min("dl").cast("int").alias("least_dl"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select("part", "slab", bucket_of(F.col("term")).alias("bucket"), "term", "n", "most_tf", "least_dl", "entries")


def statistics(index: DataFrame) -> tuple[int, float]:
    """How many texts the index holds, and their average length; one bucket is read."""
    own = index.where((F.col("bucket") == bucket_of(F.lit(""))) & (F.col("term") == ""))
    words = F.aggregate("entries.dl", F.lit(0).cast("long"), lambda a, x: a + x)
    r = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(words).alias("words")).first()
    return r.n, (r.words or 0) / r.n if r.n and r.words else 1.0


def buckets_of(terms: DataFrame) -> list[int]:
    """The buckets of the words of ``terms.term``, at most BUCKETS."""
    return sorted(r[0] for r in terms.select(F.explode(F.split("term", " ")).alias("w")).select(bucket_of(F.col("w"))).distinct().collect())


def opened(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of words and phrases among ``terms.term``; of the index only the buckets of these words are read."""
    asked = terms.select("term").distinct()
    near = index.where(F.col("bucket").isin(buckets_of(asked)))
    phrases = asked.where(F.contains("term", F.lit(" ")))
    single = near.join(asked, "term", "left_semi")
    if not phrases.take(1):
        return single
    words = F.split("term", " ")
    parts = phrases.select(F.col("term").alias("phrase"), F.size(words).alias("size"), F.posexplode(words).alias("j", "term"))
    met = near.join(parts, "term").select("part", "slab", "phrase", "size", "j", F.explode("entries").alias("e"))
    starts = met.select("part", "slab", "phrase", "size", "e.id", "e.dl", F.explode("e.at").alias("pos"), "j").groupBy("part", "slab", "phrase", "size", "id", "dl", (F.col("pos") - F.col("j")).alias("start")).agg(F.count("*").alias("c"))
    found = starts.where("c = size").groupBy("part", "slab", F.col("phrase").alias("term"), "id", "dl").agg(F.collect_list("start").alias("at"))
    return single.unionByName(_blocks(found))


def frequencies(held: DataFrame) -> DataFrame:
    """(term, df): in how many texts each term of the blocks stands."""
    return held.groupBy("term").agg(F.sum("n").alias("df"))


def entries_of(held: DataFrame) -> DataFrame:
    """(id, term, dl, tf): the postings of the blocks one by one."""
    return held.select("term", F.explode(F.arrays_zip("entries.id", "entries.dl", "entries.tf")).alias("e")).select("e.id", "term", "e.dl", "e.tf")


def saturation(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def priced(held: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(query_id, term, factor): what a term of a question weighs at full saturation."""
    return weighed(frequencies(held), terms, n)


def weighed(frequencies: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """The same from (term, df)."""
    df = F.col("df")
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return terms.join(frequencies, "term").select("query_id", "term", (idf * (K1 + 1) * F.col("times")).alias("factor"))


def slab_bounds(held: DataFrame, prices: DataFrame, avgdl: float) -> DataFrame:
    """(query_id, part, slab, most): no text of the slab scores more."""
    met = held.select("part", "slab", "term", saturation(F.col("most_tf"), F.col("least_dl"), avgdl).alias("s")).join(prices, "term")
    return met.groupBy("query_id", "part", "slab").agg(F.sum(F.col("factor") * F.col("s")).alias("most"))


def slab_scores(held: DataFrame, prices: DataFrame, pairs: DataFrame, avgdl: float) -> DataFrame:
    """(query_id, id, score) of all texts in the slabs of ``pairs`` (query_id, part, slab)."""
    met = pairs.select("query_id", "part", "slab").join(prices, "query_id").join(held.select("part", "slab", "term", "entries.id", "entries.tf", "entries.dl"), ["part", "slab", "term"])
    each = met.select("query_id", "factor", F.explode(F.arrays_zip("id", "tf", "dl")).alias("e"))
    scored = each.groupBy("query_id", F.col("e.id").alias("id")).agg(F.sum(F.col("factor") * saturation(F.col("e.tf"), F.col("e.dl"), avgdl)).alias("score"))
    return scored.withColumn("score", F.round("score", 9))


def best(held: DataFrame, terms: DataFrame, n: int, avgdl: float, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best texts of each question.

    held: the ``opened`` blocks of these terms; terms: (query_id, term, times); scope: (query_id, part), for questions about some parts only.
    """
    prices = written(priced(held, terms, n), "prices")
    bounds = slab_bounds(held, prices, avgdl)
    if scope is not None:
        tied = scope.select("query_id").distinct()
        bounds = bounds.join(tied, "query_id", "left_anti").unionByName(bounds.join(scope, ["query_id", "part"], "left_semi"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "part", "slab"))
    bounds = written(bounds, "bounds")
    first = bounds.withColumn("place", place).where(F.col("place") <= FIRST)
    seeds = written(top(slab_scores(held, prices, first, avgdl), k), "seeds")
    kth = seeds.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = remaining(bounds, kth).join(first.select("query_id", "part", "slab"), ["query_id", "part", "slab"], "left_anti")
    return top(seeds.drop("rank").unionByName(slab_scores(held, prices, rest, avgdl)), k)


def remaining(bounds: DataFrame, floors: DataFrame) -> DataFrame:
    """The slabs that may hold a text at the floor (query_id, floor) or above; all, for a question without a floor."""
    return bounds.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") + EPSILON >= F.col("floor"))).drop("floor")


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
