"""Retrieval as one plan over a table of questions: dense and lexical search, fusion, selection, gate, neighbours, packing, labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import content_terms, estimate_tokens
from colloquy.operators import postings, rank, scan, search
from colloquy.operators.chunk import header
from colloquy.settings import Settings
from colloquy.sources.scratch import Stages

#: Parts of the questions whose terms are looked up in the texts at once.
GROUP = 8
#: Columns that ``analysed`` adds to chunks; stored with them, no question embeds the texts again.
ANALYSED = ("vec",)


def analysed(chunks: DataFrame, meetings: DataFrame) -> DataFrame:
    """``chunks`` with the embedding of header and text. chunks: meeting_id, text, speakers; meetings: meeting_id, title, date."""
    named = chunks.join(meetings.select("meeting_id", "title", "date"), "meeting_id", "left")
    full = F.concat_ws("\n", header(F.coalesce("title", F.lit("Unknown meeting")), F.col("date"), F.col("speakers")), "text")
    return search.hash_vectors(named.withColumn("_full", full), text_col="_full").drop("_full", "title", "date")


def indexed(chunks: DataFrame) -> DataFrame:
    """The stemmed inverted index of chunks (meeting_id, ordinal, chunk_id, text): a meeting's chunks in slabs of their own, so a scope names whole slabs."""
    words = chunks.select(F.col("meeting_id").alias("part"), F.floor(F.col("ordinal") / postings.SLAB).cast("int").alias("slab"), F.col("chunk_id").alias("id"), search.stemmed_terms(F.col("text")).alias("w"))
    return postings.blocks(words)


def _scanned(chunks: DataFrame, terms: DataFrame, k: int, written: Callable) -> tuple[int, DataFrame, DataFrame]:
    """How many chunks there are, (term, df), and the ``k`` best chunks of each question. The texts are cut and stemmed once for each GROUP parts of the questions;
    the parts read what they hold of the asked terms."""
    texts = chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("w"))
    n, avgdl, counted, found = None, None, [], []
    for group in scan.parts_of(terms, GROUP):
        held = written(scan.matched(texts, group, search.cut_words, search.porter), "held")
        if n is None:
            n, avgdl = scan.statistics(held)
        counted.append(written(scan.frequencies(held), "frequencies"))
        found += [scan.bm25(held, counted[-1], part, n, avgdl, k) for part in scan.parts_of(group)]
    return n, reduce(DataFrame.unionByName, counted).distinct(), reduce(DataFrame.unionByName, found)


def retrieve(chunks: DataFrame, meetings: DataFrame, questions: DataFrame, settings: Settings = Settings(), scope: DataFrame | None = None, index: DataFrame | None = None, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources and gate of each question.

    chunks: chunk_id, meeting_id, ordinal, text, speakers, start_ms, end_ms, token_count, and vec where it is stored; meetings: meeting_id, title, date;
    questions: query_id, text; scope: (query_id, meeting_id), for questions about some meetings only, while those without a row ask all; index: as ``indexed`` gives
    it, where it is stored; stages: gets the time and the rows of each step. Word statistics are those of the whole corpus either way.
    Gives (query_id, label, chunk_id, via_neighbour, dense_rank, lexical_rank, fused, meeting columns, chunk columns) and (query_id, max_dense, coverage, gated).
    """
    written = (stages or Stages()).written
    asked = written(search.hash_vectors(questions.select("query_id", "text")), "asked")
    held = (chunks if set(ANALYSED) <= set(chunks.columns) else written(analysed(chunks, meetings), "analysed")).withColumnRenamed("chunk_id", "id").select("id", "meeting_id", *ANALYSED)
    chunks = chunks.drop(*ANALYSED)
    at_once = index is None and scope is None  # a batch of questions about everything needs no index
    index = written(indexed(chunks), "index") if index is None and not at_once else index

    free = asked if scope is None else asked.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    dense = search.dense_search(held.select("id", "vec"), free, settings.dense_k, settings.min_dense_similarity)
    if scope is not None:  # the scoped chunks of each question are its candidates
        own = scope.distinct().join(held.select("id", "meeting_id", "vec"), "meeting_id").join(asked.select("query_id", F.col("vec").alias("q")), "query_id")
        own = own.select("query_id", "id", F.round(search.dot(F.col("vec"), F.col("q")), 9).alias("score"))
        dense = dense.unionByName(search.top(own.where(F.col("score") >= settings.min_dense_similarity), settings.dense_k))
    dense = written(dense, "dense")

    terms = written(search.query_terms(asked, terms=lambda c: search.stemmed_phrases(content_terms(c))), "terms")
    if at_once:
        n, frequencies, lexical = _scanned(chunks, terms, settings.lexical_k, written)
    else:
        n, avgdl = postings.statistics(index)
        words = written(postings.opened(index, terms), "opened")
        frequencies = postings.frequencies(words)
        lexical = postings.best(words, terms, n, avgdl, settings.lexical_k, None if scope is None else scope.select("query_id", F.col("meeting_id").alias("part")).distinct())

    fused = written(rank.fuse_ranks(dense, lexical, settings.rrf_k).where(F.col("fused") >= settings.min_fused_score), "fused")
    sure = rank.guaranteed(fused, settings.final_k, settings.retriever_floor)
    sure = sure.withColumn("first", F.row_number().over(Window.partitionBy("query_id").orderBy("turn")))
    rest = fused.join(sure.select("query_id", "id"), ["query_id", "id"], "left_anti")
    # texts are told apart by their own words, not by the header that chunks of a meeting share
    plain = search.hash_vectors(chunks.withColumnRenamed("chunk_id", "id").select("id", "text").join(rest.select("id").distinct(), "id", "left_semi")).select("id", "vec")
    pool = rest.join(plain, "id").join(asked.select("query_id", F.col("vec").alias("q")), "query_id")
    pool = pool.select("query_id", "id", "place", "fused", "vec", F.round(search.dot(F.col("vec"), F.col("q")), 9).alias("affinity"))
    more = rank.mmr_select(pool, settings.final_k, settings.mmr_lambda)
    counts = sure.groupBy("query_id").agg(F.max("first").alias("n"))
    more = more.join(counts, "query_id", "left").withColumn("first", F.coalesce("n", F.lit(0)) + F.col("turn") + 1)
    chosen = written(sure.select("query_id", "id", "first").unionByName(more.select("query_id", "id", "first")).where(F.col("first") <= settings.final_k), "chosen")

    gate = rank.relevance_gate(asked, dense, chosen)
    best = written(chosen.join(fused, ["query_id", "id"]).join(chunks.withColumnRenamed("chunk_id", "id"), "id"), "best")
    texts = best.groupBy("query_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    wanted = written(search.coverage_terms(asked, search.stemmed_terms), "wanted")
    df = wanted.select("term", "phrase").distinct().join(frequencies.withColumnRenamed("term", "phrase"), "phrase").select("term", "df")
    coverage = rank.weighted_coverage(wanted, df, texts, n)
    gate = written(gate.join(coverage, "query_id", "left").withColumn("coverage", F.round(F.coalesce("coverage", F.lit(1.0)), 3)), "gate")

    seeds = best.select("query_id", "meeting_id", "ordinal", F.col("first").alias("place"))
    near = rank.expand_neighbours(seeds, chunks, settings.neighbour_radius, settings.neighbour_seeds)
    beside = near.join(chunks.withColumnRenamed("chunk_id", "id"), ["meeting_id", "ordinal"])
    found = best.select("query_id", "id", "dense_rank", "lexical_rank", "fused", F.lit(False).alias("via_neighbour"))
    found = found.unionByName(beside.select("query_id", "id", F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank"), F.lit(0.0).alias("fused"), F.lit(True).alias("via_neighbour")))
    full = found.join(chunks.withColumnRenamed("chunk_id", "id"), "id").join(meetings.select("meeting_id", "title", "date"), "meeting_id", "left").withColumn("title", F.coalesce("title", F.lit("Unknown meeting")))
    order = Window.partitionBy("query_id").orderBy("via_neighbour", F.desc("fused"), "id")
    priced = full.withColumn("place", F.row_number().over(order)).withColumn("cost", (F.col("token_count") + estimate_tokens(F.col("title")) + 24).cast("long"))
    kept = rank.pack_within_budget(priced.select("query_id", "id", "place", "cost"), settings.context_token_budget)
    open_ = gate.where("not gated").select("query_id")
    packed = full.join(kept.select("query_id", "id"), ["query_id", "id"], "left_semi").join(open_, "query_id", "left_semi")
    return rank.chronological(packed).withColumnRenamed("id", "chunk_id"), gate
