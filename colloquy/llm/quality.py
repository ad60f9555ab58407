"""Quality classifier with hierarchical empirical Bayes.

Document evidence: two logistic regressions fitted here on at most SAMPLE labelled texts (a documented
bound; the sample is the labels of least id hash), one for quality from text statistics, one for toxicity from the words whose
log odds stand out. A text is good if its quality is high and it isn't toxic.

Site evidence: every text of the table adds its probability of being good to its host (``source``) and path (``lang`` within the
source). Grouped sums give the global prior, each host's posterior shrunk towards it and each path's posterior
shrunk towards its host's; the prior strengths come from the spread between hosts and between paths (method of moments),
so sparse sites stay near their prior. A text's own share is left out of its site. The decision adds
the site's log odds over the global ones to the text's own.

Cases: a null text is empty; null sites are a site of their own; without labels of both kinds a head says nothing;
null ids are judged but give no labels; repeated rows count each, and of texts with one labelled id that of least key is learned from; log odds of
zero are kept; words whose log odds tie are taken in their order; very long texts are scored whole; extra columns pass through ``keep_good``
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, lookup, materialise, row_key, strings

#: Labelled texts that the heads are fitted on, and words that the toxicity head may use.
SAMPLE, WORDS = 8000, 400
STEMS = (4, 5, 6)
#: Least standard score of a word's log odds to be used.
STANDS_OUT = 3.0
#: Bound of a text's own log odds, so that no site is outvoted beyond reason.
BOUND = 8.0
_WORD = re.compile(r"[^\W\d_]+")


def text_stats(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, len(text))
    return [
        math.log1p(len(words)), min(30.0, chars / n), sum(map(str.isupper, words)) / n, sum(map(eq, words, words[1:])) / n,
        math.log1p(len(set(words))) / math.log1p(n), 1 - len(set(lines)) / max(1, len(lines)), sum(map(text.count, "#*$%&<>")) / n, text.count("!") / n,
        text.count("|") / n, text.count(".") / n, text.count(",") / n, min(50.0, n / max(1, len(lines))) / 50,
    ]


def text_words(text: str) -> set[str]:
    """The distinct words and their beginnings of STEMS letters, marked ``~``, so that forms of a rare word add up."""
    words = set(_WORD.findall(text.lower()))
    for k in STEMS:
        words |= {w[:k] + "~" for w in words if len(w) > k and w[-1] != "~"}
    return words


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray | None:
    """Weights and, last, the intercept, by Newton steps; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Heads:
    """The fitted heads; small (WORDS words at most), so it travels with the tasks."""

    def __init__(self, mean=None, scale=None, quality=None, words=None, toxic_base=0.0):
        self.mean, self.scale, self.quality, self.words, self.toxic_base = mean, scale, quality, words or {}, toxic_base

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Of being good: of high quality and not toxic."""
        good = np.full(len(texts), 1.0 if self.quality is not None or self.words else 0.5)
        if self.quality is not None and texts:
            z = (np.array([text_stats(t) for t in texts]) - self.mean) / self.scale
            good /= 1 + np.exp(-np.clip(z @ self.quality[:-1] + self.quality[-1], -30, 30))
        if self.words:
            known = self.words.keys()
            toxic = np.array([sum(self.words[w] for w in sorted(text_words(t) & known)) for t in texts])
            good /= 1 + np.exp(np.clip(toxic + self.toxic_base, -30, 30))
        good = np.clip(good, 1e-9, 1 - 1e-9)
        return np.clip(np.log(good / (1 - good)), -BOUND, BOUND)


def fit_heads(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Heads:
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = strings(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_stats(x) for x in t], pa.list_(pa.float64())), pa.array([sorted(text_words(x)) for x in t], pa.list_(pa.string())), b.column(2), b.column(3)], ["id", "stats", "words", "quality", "toxic"])

    # broadcast: at most ``sample`` ids
    rows = texts.toDF("id", "text").join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), F.col("id") == F.col("_id")).groupBy("id").agg(F.min(F.struct(row_key().alias("k"), "text")).alias("t"), F.first("_quality").alias("q"), F.first("_toxic").alias("x"))
    rows = rows.select("id", "t.text", F.col("q").cast("int"), F.col("x").cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(rows.mapInArrow(work, f"id {kind}, stats array<double>, words array<string>, quality int, toxic int"), "sample")
    dense = rows.select("id", "stats", "quality").where("quality is not null").orderBy("id").collect()
    heads = Heads()
    if dense:
        x = np.array([r.stats for r in dense])
        heads.mean, heads.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        heads.quality = fit_logistic((x - heads.mean) / heads.scale, np.array([float(r.quality) for r in dense]))
    n = rows.where("toxic is not null").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    if 0 < n.t < n.n:
        each = rows.where("toxic is not null").select(F.explode("words").alias("w"), "toxic").groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        a, b = F.col("a") + 0.5, F.col("b") + 0.5
        z = (F.log(a / (n.t - F.col("a") + 0.5)) - F.log(b / (n.n - n.t - F.col("b") + 0.5))) / F.sqrt(1 / a + 1 / b)
        picked = [r.w for r in each.withColumn("z", F.round(z, 6)).where(F.col("z") >= STANDS_OUT).orderBy(F.desc("z"), "w").limit(WORDS).collect()]
        place = {w: k for k, w in enumerate(picked)}
        if picked:
            has = rows.where("toxic is not null").select("id", "toxic", F.filter("words", lambda w: w.isin(picked)).alias("words")).orderBy("id").collect()
            x = np.zeros((len(has), len(picked)))
            for k, r in enumerate(has):
                x[k, [place[w] for w in r.words]] = 1
            w = fit_logistic(x, np.array([float(r.toxic) for r in has]), ridge=0.2)
            if w is not None:
                heads.words, heads.toxic_base = {p: float(v) for p, v in zip(picked, w)}, float(w[-1])
    return heads


def evidence(docs: DataFrame, heads: Heads, text_col: str = "text"):
    """A column: each text's own log odds."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def own(texts):
        return pd.Series(heads.log_odds(texts.fillna("").to_list()))

    return own(F.col(text_col).cast("string"))


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict]:
    """(_host, _path, _n, _s, _hn, _hs) per path, materialised, and the global prior. scored: _host, _path, _own."""
    p = _sigmoid(F.col("_own"))
    # fixed point, so that sums don't depend on the order of rows
    paths = materialise(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(F.round(p * 1_000_000).cast("long")).alias("s")), "paths")
    paths = paths.withColumn("s", F.col("s") / 1e6)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    both = materialise(paths.join(hosts, "_host"), "sites")
    mu = both.agg((F.sum("s") / F.sum("n")).alias("mu")).first().mu
    mu = 0.5 if mu is None else min(1 - 1e-6, max(1e-6, mu))
    # between-site variance: that of the sites' means beyond what their sizes explain
    spread = hosts.agg(F.sum(F.col("hn") * (F.col("hs") / F.col("hn") - mu) ** 2).alias("v"), F.count("*").alias("k"), F.sum("hn").alias("n")).first()
    inner = both.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2).alias("v"), F.count("*").alias("k"), F.sum("n").alias("n")).first()

    def strength(r):
        if not r.n:
            return 100.0
        between = max(1e-6, ((r.v or 0.0) - r.k * mu * (1 - mu)) / r.n)
        return min(1e4, max(1.0, mu * (1 - mu) / between - 1))

    both = both.withColumnsRenamed({c: f"_{c}" for c in ("n", "s", "hn", "hs")})
    return both, {"mu": mu, "host": strength(spread), "path": strength(inner)}


def posterior(prior: dict):
    """A column: a text's log odds with its site's, from _own and the site's sums; its own share is left out of the site."""
    p = _sigmoid(F.col("_own"))
    host = (F.col("_hs") - p + prior["host"] * prior["mu"]) / (F.col("_hn") - 1 + prior["host"])
    path = (F.col("_s") - p + prior["path"] * host) / (F.col("_n") - 1 + prior["path"])
    return F.round(F.col("_own") + _logit(path) - _logit(F.lit(prior["mu"])), 9), F.round(host, 9), F.round(path, 9)


def _sites(docs: DataFrame, host_col: str, path_col: str) -> DataFrame:
    return docs.withColumn("_host", F.coalesce(F.col(host_col).cast("string"), F.lit(""))).withColumn("_path", F.coalesce(F.col(path_col).cast("string"), F.lit("")))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, its own log odds, host and path posteriors, the combined log odds and kept."""
    heads = fit_heads(docs, labels, id_col=id_col, text_col=text_col)
    rows = _sites(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_h"), F.col(path_col).alias("_p")), "_h", "_p")
    scored = materialise(rows.select("_id", "_host", "_path", evidence(docs, heads, "_text").alias("_own")), "scored")
    sites, prior = site_sums(scored)
    total, host, path = posterior(prior)
    out = lookup(scored, sites, ["_host", "_path"]).select(F.col("_id").alias(id_col), F.round("_own", 6).alias("own_log_odds"), host.alias("host_posterior"), path.alias("path_posterior"), total.alias("log_odds"))
    return out.withColumn("kept", F.col("log_odds") >= 0)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` without the texts that are rejected. The scored rows are written, so that each text is scored once and none is shuffled."""
    heads = fit_heads(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.struct("*").alias("r"), F.col(text_col).alias("_text"), F.col(host_col).alias("_h"), F.col(path_col).alias("_p"))
    scored = materialise(_sites(rows, "_h", "_p").select("r", "_host", "_path", evidence(docs, heads, "_text").alias("_own")), "scored")
    sites, prior = site_sums(scored.select("_host", "_path", "_own"))
    return lookup(scored, sites, ["_host", "_path"]).where(posterior(prior)[0] >= 0).select("r.*")
