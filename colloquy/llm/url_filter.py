"""URL filters: fixed rules first, then segmented host and path tokens under multinomial naive Bayes.

Host labels are names run together. A unigram model over the words of all page texts splits each into its
likeliest words by Viterbi search; the candidate pieces of the distinct labels meet the word counts in a join,
so no vocabulary is broadcast or cut. Naive Bayes is fitted on all urls: those that a block rule decides
against all others. Its counts and scores are kept per distinct (host, path shape), a path shape having
digit runs as their length, and come back to the urls by a salted join.

Cases: a null url, or one without ``://``, has empty host and path and is judged by the class sizes alone; a null html has
no word; repeated rows keep a row each and count each; splits that tie take the shorter last piece, and a score of zero is allowed; very long texts count whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ascii_lower, lookup, materialise

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The longest label that a host name may have, and so the longest piece.
LONGEST = 63
#: Urls of one (host, path shape) that meet its score in one task; a key of more is dealt over as many tasks as that asks for.
HOT = 200_000


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def judge_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (its host and path) and rule_verdict of the longest rule that fits host and path; null where none does."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends outermost
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        verdict, name = F.when(fits, said).otherwise(verdict), F.when(fits, host + path).otherwise(name)
    return pages.withColumn("rule", name).withColumn("rule_verdict", verdict)


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over all page texts, tags dropped."""
    plain = F.regexp_replace(F.col(html_col), "<[^>]*>", " ")
    return pages.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of ``label`` under their unigram probabilities; unknown runs pay more the longer they are."""
    logs = {w: math.log(n / total) for w, n in counts.items()}
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        tries = []
        for start in range(max(0, end - LONGEST), end):
            piece = label[start:end]
            tries.append((best[start][0] + logs.get(piece, -math.log(total + 1) - 2.5 * len(piece)), start))
        best.append(max(tries))  # ties: the shortest last piece
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words array) for the distinct ``labels.label``. words: (word, n), materialised."""
    total = max(1, words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    cut = f"flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({LONGEST}, length(label) - i + 1)), k -> substring(label, i, k))))"
    pieces = labels.where("label <> ''").select("label", F.explode(F.array_distinct(F.expr(cut))).alias("word"))
    known = pieces.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            out = [best_split(label, {p["word"]: p["n"] for p in known or []}, total) for label, known in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return labels.where("label <> ''").join(known, "label", "left").select("label", "known").mapInArrow(work, "label string, words array<string>")


def naive_bayes(tokens: DataFrame) -> DataFrame:
    """(token, weight): log odds of block over allow. tokens: (token, block, allow) counts, one row per token, materialised."""
    t = tokens.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    odds = lambda n, all_: (F.col(n) + 1) / F.lit(float(all_ + t.v))
    return tokens.select("token", F.round(F.log(odds("block", t.b)) - F.log(odds("allow", t.a)), 9).alias("weight"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, and the method's score (log odds of block)."""
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    urls = judge_by_rules(split_url(slim, "_url"), rules).withColumn("shape", F.regexp_replace("path", r"\d{6,}", "/#long/"))
    for k in range(1, 6):  # upwards, so that a written length isn't met again
        urls = urls.withColumn("shape", F.regexp_replace("shape", rf"(?<!\d)\d{{{k}}}(?!\d)", f"/#{k}/"))
    urls = materialise(urls.select("_id", "host", "path", "rule", "rule_verdict", "shape"), "urls")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    blocked = F.coalesce(F.col("rule_verdict") == "block", F.lit(False))
    keys = materialise(urls.groupBy("host", "shape").agg(count(blocked)("block"), count(~blocked)("allow")), "keys")
    words = materialise(word_counts(pages.select(F.col(html_col).cast("string").alias("html"))), "words")
    labels = keys.select(F.explode(F.split("host", r"[.\-:_\d]+")).alias("label")).distinct()
    split = materialise(segment_labels(labels, words), "labels")
    sites = keys.select("host").distinct()
    by_host = sites.select("host", F.explode(F.split("host", r"[.\-:_\d]+")).alias("label")).join(split, "label").select("host", F.explode("words").alias("w")).groupBy("host").agg(F.collect_list(F.concat(F.lit("h:"), "w")).alias("hs"))
    by_path = F.transform(F.filter(F.split("shape", r"[/.\-_]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.lower(x)))
    none = F.array().cast("array<string>")
    known = materialise(keys.join(by_host, "host", "left").select("host", "shape", "block", "allow", F.concat(F.coalesce("hs", none), by_path).alias("tokens")), "tokens")
    each = known.select("host", "shape", "block", "allow", F.explode("tokens").alias("token"))
    weights = naive_bayes(materialise(each.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "counts"))
    n = known.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a")).first()
    prior = math.log((n.b + 1) / (n.a + 1))
    scores = each.join(weights, "token").groupBy("host", "shape").agg(F.round(F.sum("weight"), 6).alias("sum"))
    scored = known.select("host", "shape").join(scores, ["host", "shape"], "left").select("host", "shape", (F.coalesce("sum", F.lit(0.0)) + prior).alias("score"))
    # only keys of many urls are salted; there are fewer of them than urls / HOT
    hot = materialise(keys.where(F.col("block") + F.col("allow") > HOT).select("host", "shape", F.ceil((F.col("block") + F.col("allow")) / HOT).cast("int").alias("salts")), "hot")
    of = lambda rows: lookup(rows, hot, ["host", "shape"]).withColumn("salts", F.coalesce("salts", F.lit(1)))
    salted = of(materialise(scored, "scores")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    judged = of(urls).withColumn("salt", F.pmod(F.xxhash64("_id", "path"), F.col("salts")).cast("int")).join(salted, ["host", "shape", "salt"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))
