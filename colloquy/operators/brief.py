"""Meeting briefs by cue phrases: a map over segments and a grouped merge."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import plain_sentences, tokenize_words, trim
from colloquy.functions.timecode import parse_timecode
from colloquy.operators.chunk import segment_lines
from colloquy.operators.leading import giving_back
from colloquy.sources.scratch import written

# Cue phrases, looked for in lower-cased sentences.
DECISION = (
    "we decided", "we've decided", "we have decided", "let's go with", "we'll go with", "we will go with", "decision is", "agreed to", "we agree",
    "we're going with", "final call", "sign off on", "approved", "consensus is",
)
REVERSAL = (
    "change of plan", "reversing", "we're not going to", "we are not going to", "scrap that", "no longer", "instead of what we said", "overturn",
    "revisit that decision", "backing out", "reverse the",
)
ACTION = ("i'll", "i will", "can you", "please", "action item", "take that", "owns", "by end of", "by next", "follow up", "will send", "will draft")
QUESTION = ("open question", "not sure", "unclear", "we need to figure out", "still don't know", "tbd", "to be decided")
LINE = r"^\[(\d{1,3}:[0-5]\d(?::[0-5]\d)?)\]\s*([^:]{1,60}?):\s*(.*)$"
DUE = r"(?<![A-Za-z0-9_])by (?:the )?(?:end of |next )?[\w\s]{2,20}(?![A-Za-z0-9_])"

#: The schema of a brief; fields that are missing take defaults.
BRIEF = "summary string, topics array<string>, decisions array<struct<decision:string,rationale:string,owner:string,status:string,atMs:bigint>>, actionItems array<struct<task:string,owner:string,due:string,atMs:bigint>>, openQuestions array<string>"


#: Texts whose words are counted at a time.
TEXTS = 200
#: Most topics, decisions, actions and questions of a merged brief.
CAPS = {"topics": 10, "decisions": 15, "actions": 15, "questions": 10}
#: Fixed value: what made a brief.
MADE_BY = "offline heuristics (no LLM)"


def has_cue(c: Column, cues) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(c, F.lit(cue))
    return out


def cue_sentences(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line, pos, sentence, speaker, at_ms, decision, status, action, due, question)."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "x")).withColumn("x", trim(F.col("x")))
    get = lambda k: F.when(F.col("x").rlike(LINE), F.regexp_extract("x", LINE, k))
    rows = lines.select("id", "line", get(2).alias("speaker"), parse_timecode(get(1)).alias("at_ms"), F.posexplode(plain_sentences(F.coalesce(get(3), F.col("x")))).alias("pos", "sentence"))
    low = F.lower("sentence")
    reversal, decision = has_cue(low, REVERSAL), has_cue(low, DECISION)
    due = F.nullif(F.regexp_extract(low, f"({DUE})", 1), F.lit(""))
    action = has_cue(low, ACTION)
    asks = has_cue(low, QUESTION) | (F.col("sentence").endswith("?") & (F.size(F.split("sentence", r"\s+")) > 6))
    return rows.select("id", "line", "pos", "sentence", "speaker", "at_ms", (decision | reversal).alias("decision"), F.when(reversal, "reversed").when(decision, "agreed").alias("status"), action.alias("action"), F.when(action, due).alias("due"), asks.alias("question"))


def topics(texts: DataFrame, k: int = 8, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, n, place): the most frequent content words, ties in order of first occurrence.

    A text whose id no other row has is counted where it lies; only texts that share an id meet in a shuffle.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("shared")), "shared")
    if not shared.take(1):
        return _topics_of_rows(rows, k)
    meets = F.col("id").eqNullSafe(F.col("shared"))
    return _topics_of_rows(rows.join(shared, meets, "left_anti"), k).unionByName(_topics_of_ids(rows.join(shared, meets, "left_semi"), k))


def _topics_of_rows(rows: DataFrame, k: int) -> DataFrame:
    """``topics`` of (id, text) with one row per id."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            found = [Counter(w or ()).most_common(k) for w in b.column(1).to_pylist()]  # equal counts stay in order of first occurrence
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            term, n = pa.array([t for x in found for t, _ in x], pa.string()), pa.array([c for x in found for _, c in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), term, n, pa.array([i for x in found for i in range(1, len(x) + 1)], pa.int32())], ["id", "term", "n", "place"])

    words = F.flatten(F.transform(F.split("text", "\n"), lambda x: tokenize_words(_said(trim(x)))))
    return rows.select("id", words.alias("w")).mapInArrow(giving_back(work), f"id {kind}, term string, n long, place int")


def _said(line: Column) -> Column:
    """A line without its time and speaker."""
    return F.when(line.rlike(LINE), F.regexp_extract(line, LINE, 3)).otherwise(line)


def _topics_of_ids(texts: DataFrame, k: int) -> DataFrame:
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("x", trim(F.col("x")))
    words = lines.select("id", "line", F.posexplode(tokenize_words(_said(F.col("x")))).alias("pos", "term"))
    counted = words.groupBy("id", "term").agg(F.count("*").alias("n"), F.min(F.struct("line", "pos")).alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "first")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("id", "term", "n", "place")


def brief(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, summary, topics, decisions, actions, questions) with at most 8, 12, 12 and 8 entries; actions and questions once each. The summary counts what was found before any cut."""
    rows = cue_sentences(texts, id_col, text_col)
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("line", "pos", c.alias("v"))))), lambda x: x["v"])

    def listed(flag: str, value: Column, name: str, cap: int, once: bool) -> DataFrame:
        own = rows.where(flag)
        first = F.row_number().over(Window.partitionBy("id", "sentence").orderBy("line", "pos")) == 1
        own = own.withColumn("keep", first if once else F.lit(True))
        return own.groupBy("id").agg(F.slice(order(value), 1, cap).alias(name), F.count("*").alias(f"n_{name}"))

    d = listed("decision", F.struct(F.col("sentence").alias("decision"), F.col("speaker").alias("owner"), "status", F.col("at_ms").alias("atMs")), "decisions", 12, False)
    a = listed("action", F.struct(F.col("sentence").alias("task"), F.col("speaker").alias("owner"), "due", F.col("at_ms").alias("atMs")), "actions", 12, True)
    q = listed("question", F.col("sentence"), "questions", 8, True)
    t = topics(texts, 8, id_col, text_col).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("topics"))
    lines = texts.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, "\n")).alias("x")).withColumn("x", trim(F.col("x")))
    out = lines.groupBy("id").agg(F.count("*").alias("n_lines"), F.countDistinct(F.when(F.col("x").rlike(LINE), F.regexp_extract("x", LINE, 2))).alias("n_speakers"))
    for part in (t, d, a, q):
        out = out.join(part, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    terms = F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 5), ", ")
    summary = F.concat(n("n_lines"), F.lit(" lines from "), n("n_speakers"), F.lit(" speaker(s). Recurring terms: "), terms, F.lit(". Cue phrases found "), n("n_decisions"), F.lit(" decision(s) and "), n("n_actions"), F.lit(" commitment(s)."))
    return out.select("id", summary.alias("summary"), *CAPS)


def read_brief(c: Column) -> Column:
    """A brief out of a model's reply: a fenced block, the outermost braces or the whole; the first candidate that holds wins, as JSON variant checks say."""
    fenced = F.nullif(F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(\{[\s\S]*\})", 1), F.lit(""))

    def read(x: Column) -> Column:
        v = F.try_parse_json(x)
        kind = F.schema_of_variant(v)
        lists = F.lit(True)
        for name in ("topics", "decisions", "actionItems", "openQuestions"):
            # wrong types fail the candidate, a missing list does not
            lists = lists & (F.try_variant_get(v, f"$.{name}", "variant").isNull() | F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).startswith("ARRAY"))
        b = F.from_json(x, BRIEF)
        filled = F.forall(F.coalesce(b["decisions"], F.array()), lambda d: F.length(F.coalesce(d["decision"], F.lit(""))) > 0) & F.forall(F.coalesce(b["actionItems"], F.array()), lambda a: F.length(F.coalesce(a["task"], F.lit(""))) > 0)
        return F.when(v.isNotNull() & kind.startswith("OBJECT") & lists & filled, b)

    return F.coalesce(read(fenced), read(braces), read(c))


def merge_briefs(parts: DataFrame, local: bool = False) -> DataFrame:
    """One brief per id from those of its segments in order: summaries one after another, each list without repeats (decisions and actions by their text) and cut to its cap.

    local: the plain merge that stands in where a reply can't be read: decisions and actions as they come, only topics are cut.
    parts: id, ordinal, and of summary, topics, decisions, actions and questions those that there are.
    """
    lists = [c for c in CAPS if c in parts.columns]
    said = ["summary"] if "summary" in parts.columns else []
    rows = F.array_sort(F.collect_list(F.struct("ordinal", *said, *lists)))
    out = parts.groupBy("id").agg(rows.alias("r"))
    key = {"decisions": "decision", "actions": "task"}

    def once(c: str) -> Column:
        all_ = F.flatten(F.transform("r", lambda r: F.coalesce(r[c], F.array())))
        if c not in key:
            return F.array_distinct(all_)
        names = F.transform(all_, lambda x: x[key[c]])
        return all_ if local else F.filter(all_, lambda x, i: F.array_position(names, x[key[c]]) == i + 1)

    cut = lambda c: once(c) if local and c != "topics" else F.slice(once(c), 1, CAPS[c])
    whole = F.array_join(F.filter(F.transform("r", lambda r: r["summary"]), lambda x: x != ""), " ") if said else None
    return out.select("id", *([F.when(whole == "", F.lit("" if local else "No content extracted.")).otherwise(whole).alias("summary")] if said else []), *[cut(c).alias(c) for c in lists])


def meeting_briefs(texts: DataFrame, budget: int = 3000, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, segments, generated_by, summary, topics, decisions, actions, questions): the text in segments of ``budget`` tokens, a brief of each, and their merge."""
    segments = segment_lines(texts, budget, id_col, text_col)
    named = segments.select(F.struct("id", "ordinal").alias("id"), "text")
    parts = brief(named).select("id.id", "id.ordinal", "summary", *CAPS)
    counts = segments.groupBy("id").agg(F.count("*").cast("int").alias("segments"))
    return counts.withColumn("generated_by", F.lit(MADE_BY)).join(merge_briefs(parts), "id")
