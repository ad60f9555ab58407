"""Fusion, selection, expansion and packing of candidates; query_id keys every step, so a table of questions is one plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.settings import Settings


def fuse_ranks(dense: DataFrame, lexical: DataFrame, k: int = Settings.rrf_k) -> DataFrame:
    """(query_id, id, dense_rank, lexical_rank, fused, place): reciprocal rank fusion; ties in order of dense, then lexical rank."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    share = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = d.join(x, ["query_id", "id"], "full_outer").withColumn("fused", share("dense_rank") + share("lexical_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "id")
    return both.withColumn("place", F.row_number().over(w))


def guaranteed(candidates: DataFrame, final_k: int = Settings.final_k, floor: int = Settings.retriever_floor) -> DataFrame:
    """(query_id, id, turn): the best of each list in turns, dense first."""
    n = min(floor, final_k // 2)
    turn = lambda c, odd: F.when(F.col(c) <= n, 2 * (F.col(c) - 1) + odd)
    return candidates.select("query_id", "id", F.least(turn("dense_rank", 0), turn("lexical_rank", 1)).alias("turn")).where("turn is not null")


def expand_neighbours(selected: DataFrame, chunks: DataFrame, radius: int = Settings.neighbour_radius, seeds: int = Settings.neighbour_seeds) -> DataFrame:
    """(query_id, meeting_id, ordinal): chunks beside the first ``seeds`` selected, by equality on the wanted ordinals. selected: query_id, meeting_id, ordinal, place."""
    near = selected.where(F.col("place") <= seeds).select("query_id", "meeting_id", F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius)).alias("ordinal")).where("ordinal >= 0").distinct()
    return near.join(selected, ["query_id", "meeting_id", "ordinal"], "left_anti").join(chunks.select("meeting_id", "ordinal"), ["meeting_id", "ordinal"], "left_semi")


def pack_within_budget(sources: DataFrame, budget: int = Settings.context_token_budget) -> DataFrame:
    """(query_id, id, place): sources in order that still fit; one that doesn't is passed over, the first always stays. sources: query_id, id, place, cost."""
    rows = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "cost"))).alias("r"))
    kind = sources.schema
    item = f"struct<place:{kind['place'].dataType.simpleString()},id:{kind['id'].dataType.simpleString()},cost:{kind['cost'].dataType.simpleString()}>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("kept"))
    fits = lambda s, x: (F.size(s["kept"]) == 0) | (s["used"] + x["cost"] <= budget)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["cost"]).cast("long").alias("used"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    return rows.select("query_id", F.explode(F.aggregate("r", start, step, lambda s: s["kept"])).alias("x")).select("query_id", "x.id", "x.place", "x.cost")


def chronological(sources: DataFrame) -> DataFrame:
    """Adds label S1, S2, ... by date, meeting, start and ordinal; undated meetings come last."""
    w = Window.partitionBy("query_id").orderBy(F.coalesce("date", F.lit("9999")), "meeting_id", F.coalesce("start_ms", F.lit(0)), "ordinal")
    return sources.withColumn("label", F.concat(F.lit("S"), F.row_number().over(w).cast("string")))


def mmr_select(candidates: DataFrame, limit: int, lam: float = Settings.mmr_lambda) -> DataFrame:
    """(query_id, id, turn): maximal marginal relevance. candidates: query_id, id, place, fused, vec, affinity (dot with the query).

    Selection is sequential, so each query's few candidates are one group; strict comparison lets the first in order win ties.
    """
    import numpy as np

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable").reset_index(drop=True)
        if len(pdf) > 1 and limit > 0:
            low, high = pdf["fused"].min(), pdf["fused"].max()
            relevance = 0.7 * ((pdf["fused"] - low) / ((high - low) or 1)) + 0.3 * pdf["affinity"]
            vectors = np.stack(pdf["vec"].to_list()).astype(float)
            nearest, left, order = np.zeros(len(pdf)), list(range(len(pdf))), []
            while left and len(order) < limit:
                values = [round(lam * relevance[i] - (1 - lam) * nearest[i], 12) for i in left]
                best = left.pop(values.index(max(values)))
                sims = vectors @ vectors[best]
                nearest = np.maximum(nearest, sims)  # from zero on: unlike texts earn nothing
                order.append(best)
            pdf = pdf.iloc[order]
        pdf = pdf.head(limit)
        return pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "turn": range(len(pdf))})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy("query_id").applyInPandas(select, f"query_id {kinds['query_id']}, id {kinds['id']}, turn long")


def weighted_coverage(terms: DataFrame, frequencies: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(query_id, coverage): share of the query's terms, by rarity, that the retrieved text holds. terms: (query_id, term); texts: (query_id, text)."""
    weighed = terms.join(frequencies, "term", "left").withColumn("w", F.log(1 + n / (1 + F.coalesce("df", F.lit(0)))))
    held = weighed.join(texts, "query_id", "left").withColumn("hit", F.coalesce(F.contains(F.lower("text"), F.col("term")), F.lit(False)))
    return held.groupBy("query_id").agg(F.when(F.sum("w") == 0, 1.0).otherwise(F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))


def relevance_gate(queries: DataFrame, dense: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, max_dense, gated): a query is refused if nothing was selected or no dense hit stands behind it."""
    d = dense.groupBy("query_id").agg(F.round(F.max("score"), 4).alias("max_dense"), F.count("*").alias("n_dense"))
    s = selected.groupBy("query_id").agg(F.count("*").alias("n_selected"))
    joined = queries.select("query_id").join(d, "query_id", "left").join(s, "query_id", "left")
    return joined.select("query_id", F.coalesce("max_dense", F.lit(0.0)).alias("max_dense"), (F.coalesce("n_dense", F.lit(0)) == 0).__or__(F.coalesce("n_selected", F.lit(0)) == 0).alias("gated"))
