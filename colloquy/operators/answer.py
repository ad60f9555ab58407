"""From sources to prompts, extractive answers, usage and traces."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.guardrails import matches, whole_meeting_question
from colloquy.functions.text import capped, distinct, plain_sentences, tokenize_words, trim, truncate
from colloquy.functions.timecode import format_range
from colloquy.operators.rank import chronological
from colloquy.settings import Settings

# Dollars for a million tokens in and out.
PRICES = {
    "gpt-4.1-mini": (0.4, 1.6), "gpt-4.1": (2.0, 8.0), "gpt-4.1-nano": (0.1, 0.4), "gpt-4o-mini": (0.15, 0.6), "gpt-4o": (2.5, 10.0),
    "text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0),
}
# The frame of an extractive answer.
FOUND = "Based on the retrieved excerpts (offline extractive mode — no language model was used):"
CLOSEST = "Offline mode found no sentence matching those words, so here is the closest retrieved excerpt instead."
OPEN = "Open the sources panel to read the surrounding turns in context."


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Zero for a model without a price."""
    price = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[k])]), model), F.lit(0.0))
    return tokens_in / 1_000_000 * price(0) + tokens_out / 1_000_000 * price(1)


def route(question: Column, scope_size: Column, tokens: Column, ceiling: int = Settings.whole_meeting_tokens) -> Column:
    """whole-meeting where one to three meetings fit the ceiling and the question asks for all of them or they fit twice; else retrieval."""
    fits = scope_size.between(1, 3) & (tokens <= ceiling)
    return F.when(fits & (whole_meeting_question(question) | (tokens <= ceiling / 2)), "whole-meeting").otherwise("retrieval")


def rewrite(question: Column, history: Column) -> Column:
    """The question with the last eight distinct words of the history, if it leans on them."""
    leans = matches(question, r"\b(it|that|this|they|them|those|he|she|there|the same|instead)\b") | (F.size(tokenize_words(question)) <= 3)
    words = distinct(tokenize_words(history))
    last = F.slice(words, F.greatest(F.size(words) - 7, F.lit(1)), 8)
    return F.when(leans & (F.size(words) > 0), F.concat(question, F.lit(" ("), F.array_join(last, " "), F.lit(")"))).otherwise(question)


def render_sources(sources: DataFrame) -> DataFrame:
    """(query_id, block): sources in label order. sources: query_id, label, title, date, start_ms, end_ms, speakers, text."""
    head = F.concat_ws(" | ", F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("title")), F.coalesce("date", F.lit("undated")), format_range(F.col("start_ms"), F.col("end_ms")), F.array_join("speakers", ", "))
    n = F.substr("label", F.lit(2)).cast("int")
    rows = F.array_sort(F.collect_list(F.struct(n.alias("n"), F.concat(head, F.lit("\n"), F.col("text")).alias("x"))))
    return sources.groupBy("query_id").agg(F.concat(F.lit("<sources>\n"), F.array_join(F.transform(rows, lambda r: r["x"]), "\n\n"), F.lit("\n</sources>")).alias("block"))


def parse_sources(blocks: DataFrame) -> DataFrame:
    """(query_id, label, meta, text): the inverse of ``render_sources``."""
    inner = F.regexp_replace("block", r"^[\s\S]*?<sources>\n?|\n?</sources>[\s\S]*$", "")
    lines = blocks.select("query_id", F.posexplode(F.split(inner, "\n")).alias("pos", "line"))
    opens = F.col("line").rlike(r"^\[S\d+\]")
    lines = lines.withColumn("n", F.sum(opens.cast("int")).over(Window.partitionBy("query_id").orderBy("pos"))).where("n > 0")
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    found = lines.groupBy("query_id", "n").agg(F.transform(rows, lambda r: r["line"]).alias("l"))
    return found.select("query_id", F.regexp_extract(F.col("l")[0], r"^\[(S\d+)\]", 1).alias("label"), trim(F.regexp_replace(F.col("l")[0], r"^\[S\d+\]", "")).alias("meta"), trim(F.array_join(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), "\n")).alias("text"))


def history_lines(turns: Column, last: int, chars: int) -> Column:
    """``role: content`` of the last turns, each cut to ``chars``."""
    kept = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), last)
    return F.array_join(F.transform(kept, lambda t: F.concat(t["role"], F.lit(": "), truncate(t["content"], chars))), "\n")


def extractive_sentences(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, sentence, labels, score, place): the best four sentences; the same one under several labels is one.

    sources: query_id, label, text; questions: query_id, question.
    """
    each = sources.select("query_id", "label", F.substr("label", F.lit(2)).cast("int").alias("n"), F.posexplode(plain_sentences(F.col("text"))).alias("pos", "sentence"))
    asked = questions.select("query_id", tokenize_words(F.col("question")).alias("q"))
    words = tokenize_words(F.col("sentence"))
    hits = F.size(F.filter(words, lambda w: F.array_contains(F.col("q"), w)))
    scored = each.join(asked, "query_id").withColumn("score", F.round(hits / F.sqrt(F.size(words) + 1), 9)).where("score > 0")
    key = trim(F.regexp_replace("sentence", r"^\[[^\]]+\]\s*", ""))
    at = F.struct("n", "pos")
    merged = scored.groupBy("query_id", key.alias("sentence")).agg(F.array_sort(F.collect_set("n")).alias("ns"), F.max("score").alias("score"), F.min(at).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    labels = F.array_join(F.transform("ns", lambda n: F.concat(F.lit("S"), n.cast("string"))), ", ")
    return merged.withColumn("place", F.row_number().over(w)).where("place <= 4").select("query_id", "sentence", labels.alias("labels"), "score", "place")


def extractive_answer(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, answer)."""
    best = extractive_sentences(sources, questions)
    line = F.concat(F.lit("- "), F.col("sentence"), F.lit(" ["), F.col("labels"), F.lit("]"))
    lines = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("x")))), lambda r: r["x"]), "\n").alias("lines"))
    n = F.substr("label", F.lit(2)).cast("int")
    first = sources.groupBy("query_id").agg(F.min_by(F.struct("label", "text"), n).alias("f"))
    excerpt = F.coalesce(F.get(plain_sentences(F.col("f.text")), F.lit(0)), F.col("f.text"))
    joined = questions.select("query_id").join(first, "query_id", "left").join(lines, "query_id", "left")
    answer = (
        F.when(F.col("f").isNull(), "I could not find anything in the indexed meetings that speaks to that.")
        .when(F.col("lines").isNull(), F.concat(F.lit(CLOSEST + "\n\n"), trim(F.concat(excerpt, F.lit(" ["), F.col("f.label"), F.lit("]")))))
        .otherwise(F.concat(F.lit(FOUND + "\n\n"), F.col("lines"), F.lit("\n\n" + OPEN)))
    )
    return joined.select("query_id", answer.alias("answer"))


def whole_sources(meetings: DataFrame) -> DataFrame:
    """One source per meeting of a question, its transcript, labelled by date. meetings: query_id, meeting_id, title, date, duration_ms, participants, transcript."""
    rows = meetings.select(
        "query_id", F.concat("meeting_id", F.lit(":full")).alias("chunk_id"), "meeting_id", "title", "date", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"),
        F.col("participants").alias("speakers"), F.col("transcript").alias("text"), F.lit(0).alias("ordinal"), F.lit(1.0).alias("fused"), F.lit(False).alias("via_neighbour"),
    )
    return chronological(rows)


def prompts(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, prompt): history, sources and question. questions: query_id, question, history (turns), route."""
    last = F.when(F.col("route") == "whole-meeting", history_lines(F.col("history"), 4, 300)).otherwise(history_lines(F.col("history"), 6, 400))
    said = F.when(F.size("history") > 0, F.concat(F.lit("Earlier in this conversation:\n"), last, F.lit("\n\n"))).otherwise("")
    joined = questions.join(render_sources(sources), "query_id", "left")
    return joined.select("query_id", F.concat(said, F.coalesce("block", F.lit("<sources>\n\n</sources>")), F.lit("\n\nQuestion: "), trim(F.col("question"))).alias("prompt"))


def traces(answers: DataFrame, sources: DataFrame, stages: list[tuple[str, int, dict]] = (), models: dict[str, str] | None = None) -> DataFrame:
    """(trace_id, created_at, question, payload): what is stored of each answer, source texts cut to 4000 characters.

    answers: query_id, trace_id, question, standalone, route, answer, model, tokens_in, tokens_out, usd and the verdict columns; stages: (stage, ms, detail) of the
    steps that the questions took together.
    """
    each = F.struct("label", "chunk_id", "title", "date", F.round("fused", 5).alias("fused"), "via_neighbour", capped(F.col("text"), 4000).alias("text"))
    shown = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.substr("label", F.lit(2)).cast("int").alias("n"), each.alias("s")))).alias("s"))
    rows = answers.join(shown, "query_id", "left")
    steps = F.parse_json(F.lit(json.dumps([{"stage": s, "ms": ms, "detail": detail} for s, ms, detail in stages])))
    used = F.struct(F.col("model").alias("chat"), *[F.lit(v).alias(k) for k, v in (models or {}).items()])
    payload = F.to_json(F.struct("standalone", "route", "answer", "coverage", "invalid", "declined", "flags", F.struct("model", "tokens_in", "tokens_out", "usd").alias("usage"), used.alias("models"), steps.alias("stages"), F.coalesce(F.transform("s", lambda x: x["s"]), F.array()).alias("sources")))
    return rows.select("trace_id", now().alias("created_at"), "question", payload.alias("payload"))


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def trace_stages(traces: DataFrame) -> DataFrame:
    """(trace_id, stage, ms, detail): the steps of stored traces; detail is a variant."""
    steps = F.variant_get(F.try_parse_json("payload"), "$.stages", "array<struct<stage:string,ms:long,detail:variant>>")
    return traces.select("trace_id", F.explode(steps).alias("x")).select("trace_id", "x.stage", "x.ms", "x.detail")


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event): a JSON line with the route and question, one for each piece of the answer, and one that it is done; of an answer with ``error``, that alone."""
    line = lambda kind, data: F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data")))
    pieces = F.regexp_extract_all("answer", F.lit(r"(\S+\s*)"), 1)
    meta = F.array(line("meta", F.struct("route", "standalone")))
    each = F.transform(pieces, lambda p: line("delta", F.struct(p.alias("text"))))
    done = F.array(line("done", F.struct("answer", *([F.col("trace_id").alias("traceId")] if "trace_id" in answers.columns else []))))
    failed = F.array(line("error", F.struct(F.col("error").alias("message"))))
    return answers.select("query_id", F.posexplode(F.when(F.col("error").isNotNull(), failed).otherwise(F.concat(meta, each, done))).alias("seq", "event"))
