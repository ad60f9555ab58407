"""Retrieval evaluation and status figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import normalise


def recall(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, recall, missing): share of a case's needles that its retrieved text holds; 1 for none. cases: (query_id, needles); texts: (query_id, text)."""
    each = cases.select("query_id", F.explode_outer("needles").alias("needle")).join(texts, "query_id", "left")
    hit = F.coalesce(F.contains(normalise(F.col("text")), normalise(F.col("needle"))), F.lit(False))
    rows = each.withColumn("hit", F.when(F.col("needle").isNotNull(), hit.cast("int")))
    return rows.groupBy("query_id").agg(F.coalesce(F.avg("hit"), F.lit(1.0)).alias("recall"), F.array_sort(F.collect_list(F.when(F.col("hit") == 0, F.col("needle")))).alias("missing"))


def outcomes(cases: DataFrame, answers: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per case: recall and missing of its needles, refused, refusal_correct, keywords (share of the words to mention that the answer has), coverage, n_invalid, usd.

    cases: query_id, needles, mentions, expect_refusal; answers: query_id, route, answer, coverage, invalid, declined, usd; texts: (query_id, text) retrieved.
    """
    said = answers.select("query_id", (F.col("route") == "refused").alias("gated"), F.lower("answer").alias("a"), "coverage", F.size("invalid").alias("n_invalid"), "declined", "usd")
    rows = cases.join(recall(cases, texts), "query_id", "left").join(said, "query_id", "left")
    refused = F.coalesce(F.col("gated") | F.col("declined"), F.lit(True))  # no answer is a refusal
    hits = F.size(F.filter("mentions", lambda w: F.contains(F.col("a"), F.lower(w))))
    keywords = F.when(F.size("mentions") > 0, hits / F.size("mentions")).otherwise(1.0)
    return rows.select("query_id", "recall", "missing", refused.alias("refused"), (refused == F.coalesce("expect_refusal", F.lit(False))).alias("refusal_correct"), F.coalesce(keywords, F.lit(0.0)).alias("keywords"), "coverage", F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), F.coalesce("usd", F.lit(0.0)).alias("usd"))


def summary(judged: DataFrame, remote: bool = False, least: float = 0.8) -> DataFrame:
    """One row over all cases: means, sums (coverage without refusals) and passed; refusals must be right only where a remote model judges them."""
    one = judged.agg(
        F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.col("refusal_correct").cast("int")), 6).alias("refusals"), F.round(F.avg("keywords"), 6).alias("keywords"),
        F.round(F.avg(F.when(~F.col("refused"), F.col("coverage"))), 6).alias("coverage"), F.sum("n_invalid").alias("invalid"), F.round(F.sum("usd"), 6).alias("usd"), F.bool_and("refusal_correct").alias("all_right"),
    )
    return one.withColumn("passed", (F.col("recall") >= least) & (F.col("all_right") | F.lit(not remote))).drop("all_right")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the element in the middle, the upper of two, from counts per value rather than a sorted list."""
    w = Window.partitionBy(*by).orderBy("_v")
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    run = cells.withColumn("_run", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    return run.where(F.col("_run") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min("_v").alias("median"))


def gate_separation(df: DataFrame, answerable, signals: list[str]) -> DataFrame:
    """(signal, least_answerable, most_refusable, separable, overlap) for each signal column; overlap: by how much the two kinds lie across each other."""
    named = df.select(answerable.alias("ok"), F.explode(F.create_map(*[x for s in signals for x in (F.lit(s), F.col(s).cast("double"))])).alias("signal", "v"))
    g = named.groupBy("signal").agg(F.min(F.when(F.col("ok"), F.col("v"))).alias("least_answerable"), F.max(F.when(~F.col("ok"), F.col("v"))).alias("most_refusable"))
    apart = F.coalesce(F.col("least_answerable") > F.col("most_refusable"), F.lit(True))
    return g.withColumn("separable", apart).withColumn("overlap", F.when(apart, 0.0).otherwise(F.col("most_refusable") - F.col("least_answerable")))


def gate_counts(df: DataFrame, answerable, gated) -> DataFrame:
    """One row: refusable, deferred (of these, let through to the model), answerable, wrongly_refused (of these, refused by the gate)."""
    n = lambda c: F.count_if(c)
    return df.agg(n(~answerable).alias("refusable"), n(~answerable & ~gated).alias("deferred"), n(answerable).alias("answerable"), n(answerable & gated).alias("wrongly_refused"))


def latency_share(stages: DataFrame, total_by: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Adds share: each stage's part of its trace in whole percent, two at least. stages: total_by, ms.

    Totals are summed as decimals, since a sum of doubles follows the order of its rows; values too large for that, or not finite, as doubles.
    With ``order_by`` they are the sums of doubles that a reader of the rows in this order gets, whatever order they lie in.
    """
    w = Window.partitionBy(*total_by)
    if order_by:
        w = w.orderBy(*order_by)
        run = stages.withColumn("_run", F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        stages = run.withColumn("_total", F.last("_run").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_run")
    else:
        exact = F.col("ms").try_cast("decimal(38,18)")
        fits = F.count("ms").over(w) == F.count(exact).over(w)
        stages = stages.withColumn("_total", F.coalesce(F.when(fits, F.try_sum(exact).over(w).cast("double")), F.sum("ms").over(w)))
    share = F.floor(F.col("ms") / F.greatest("_total", F.lit(1.0)) * 100 + 0.5)
    return stages.withColumn("share", F.greatest(F.lit(2), share).cast("long")).drop("_total")


def corpus_status(turns: DataFrame, tokens) -> DataFrame:
    """meetings, turns and tokens of the whole corpus in one row."""
    per = turns.groupBy("id").agg(F.count("*").alias("turns"), F.sum(tokens).alias("tokens"))
    return per.agg(F.count("*").alias("meetings"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
