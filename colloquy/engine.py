"""The engine: a store of meetings, and questions answered in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import guardrails
from colloquy.functions.text import estimate_tokens, trim
from colloquy.operators import answer, brief, chunk, evaluate
from colloquy.plans.retrieve import retrieve
from colloquy.settings import Settings
from colloquy.sources.scratch import Stages, written
from colloquy.sources.store import Store
from colloquy.sources.transcripts import check_requests, read_directory, write_events
from colloquy.streaming.ingest import ingest


class Engine:
    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, Store(spark, path), settings or Settings.from_env()

    def ingest(self, files: DataFrame) -> int:
        """files: filename, content, and title and date where known; those that fail the request checks are stored as rejected."""
        checked = check_requests(files.select("filename", "content", *[(F.col(c).cast("string") if c in files.columns else F.lit(None).cast("string")).alias(c) for c in ("title", "date")]))
        return ingest(self.store, checked, self.settings)

    def ingest_dir(self, path: str) -> int:
        """The transcript files of a folder; those that can't be read or hold no dialogue are stored as rejected."""
        return ingest(self.store, read_directory(self.spark, path), self.settings)

    def rejected(self) -> DataFrame | None:
        """(id, filename, error) of the files that were not stored."""
        return self.store.table("rejected")

    def meetings(self) -> DataFrame | None:
        return self.store.meetings()

    def meeting(self, meeting_id: str) -> DataFrame:
        return self._one("meetings", "id", meeting_id)

    def trace(self, trace_id: str) -> DataFrame:
        return self._one("traces", "trace_id", trace_id)

    def transcript(self, meeting_id: str) -> DataFrame:
        """The turns of a meeting in their order."""
        self._one("meetings", "id", meeting_id)
        return self.store.find("turns", self.spark.createDataFrame([(meeting_id,)], "id string")).orderBy("index")

    def _one(self, table: str, key: str, value: str) -> DataFrame:
        ids = self.spark.createDataFrame([(value,)], f"{key} string")
        found = self.store.find(table, ids)
        if found is None or not found.take(1):
            raise KeyError(value)
        briefs = self.store.find("briefs", ids) if table == "meetings" else None
        return found if briefs is None else found.join(briefs, "id", "left")

    def write_briefs(self, ids: DataFrame | None = None) -> int:
        """Brief the stored meetings, or those of ``ids`` (id), segment by segment, and store the merged briefs."""
        lines = self.store.table("turns").select("id", "index", chunk.rendered().alias("line"))
        lines = lines if ids is None else lines.join(ids.select("id"), "id", "left_semi")
        texts = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("text"))
        return self.store.save_brief(brief.meeting_briefs(texts))

    def delete(self, ids: DataFrame) -> int:
        return self.store.delete(ids)

    def traces(self, limit: int = 25) -> DataFrame | None:
        return self.store.latest_traces(limit)

    def status(self) -> DataFrame:
        turns = self.store.table("turns")
        if turns is None:
            return self.spark.createDataFrame([(0, 0, 0, 0)], "meetings long, turns long, tokens long, chunks long")
        chunks = self.store.table("chunks")
        return evaluate.corpus_status(turns, estimate_tokens(F.col("text"))).withColumn("chunks", F.lit(0 if chunks is None else chunks.count()).cast("long"))

    def latency(self) -> DataFrame | None:
        """(trace_id, stage, ms, detail, share): the steps of stored traces and their part of the whole in percent."""
        t = self.store.table("traces")
        return None if t is None else evaluate.latency_share(answer.trace_stages(t), ["trace_id"])

    def retrieve(self, questions: DataFrame, scope: DataFrame | None = None, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
        chunks = self.store.table("chunks").withColumnRenamed("id", "meeting_id").withColumn("chunk_id", F.concat_ws(":", "meeting_id", F.col("ordinal").cast("string")))
        meetings = self.store.table("meetings").select(F.col("id").alias("meeting_id"), "title", "date")
        return retrieve(chunks, meetings, questions, self.settings, scope, self.store.table("postings").withColumnRenamed("id", "part"), stages)

    def ask(self, questions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, trace_id, question, standalone, route, answer, coverage, invalid, declined, flags, model, tokens_in, tokens_out, usd), one row per question; each leaves a trace.

        questions: query_id, text, and history, an array of (role, content), where there is one. scope: (query_id, meeting_id). Refused questions (empty, too
        long, no evidence) get their refusal and no search; up to three meetings that fit are read whole where the question asks for it.
        """
        stages = Stages()
        history = F.col("history") if "history" in questions.columns else F.array().cast("array<struct<role:string,content:string>>")
        asked = questions.select("query_id", F.col("text").alias("question"), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")).alias("history"))
        past = answer.history_lines(F.col("history"), 6, 300)
        new = answer.rewrite(F.col("question"), past)
        standalone = F.when((F.size("history") > 0) & (F.length(new) > 2), new).otherwise(F.col("question"))
        asked = asked.withColumn("standalone", standalone).withColumn("refusal", guardrails.check_question(F.col("question"), self.settings.max_question_chars))
        meetings, empty = self.store.table("meetings"), self.store.table("chunks") is None
        if scope is None or empty:
            asked = asked.withColumn("route", F.lit("retrieval"))
        else:
            fit = scope.join(meetings.select(F.col("id").alias("meeting_id"), "token_count"), "meeting_id").groupBy("query_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
            way = answer.route(F.col("question"), F.coalesce("n", F.lit(0)), F.coalesce("tokens", F.lit(0)), self.settings.whole_meeting_tokens)
            asked = asked.join(fit, "query_id", "left").withColumn("route", way).drop("n", "tokens")
        asked = stages.written(asked, "understand")
        fair = asked.where("refusal is null")
        refused = asked.where("refusal is not null").select("query_id", F.col("refusal").alias("answer"))
        if empty:
            none = fair.select("query_id", guardrails.no_evidence(F.col("question"), F.lit(True)).alias("answer"))
            return self._judged(asked, refused.unionByName(none).withColumn("refused", F.lit(True)), None, stages)
        searched = fair.where("route = 'retrieval'").select("query_id", F.col("standalone").alias("text"))
        sources, gate = self.retrieve(searched, scope, stages)
        shown = ["query_id", "label", "chunk_id", "title", "date", "start_ms", "end_ms", "speakers", "text", "fused", "via_neighbour"]
        sources = sources.select(*shown)
        if scope is not None:
            read = scope.join(fair.where("route = 'whole-meeting'").select("query_id"), "query_id", "left_semi").join(meetings.withColumnRenamed("id", "meeting_id"), "meeting_id")
            sources = sources.unionByName(answer.whole_sources(read).select(*shown))
        sources = stages.written(sources, "sources")
        shut = gate.where("gated").join(fair, "query_id").select("query_id", guardrails.no_evidence(F.col("question"), F.lit(False)).alias("answer"))
        open_ = fair.join(shut, "query_id", "left_anti").select("query_id", trim(F.col("standalone")).alias("question"))
        told = answer.extractive_answer(sources.select("query_id", "label", "text"), open_)
        return self._judged(asked, refused.unionByName(shut).withColumn("refused", F.lit(True)).unionByName(told.withColumn("refused", F.lit(False))), sources, stages)

    def _judged(self, asked: DataFrame, answers: DataFrame, sources: DataFrame | None, stages: Stages) -> DataFrame:
        none = F.array().cast("array<string>")
        rows = asked.drop("refusal").join(answers, "query_id").withColumn("route", F.when(F.col("refused"), "refused").otherwise(F.col("route")))
        if sources is None:
            rows = rows.withColumn("labels", none).withColumn("prompt", F.lit(""))
        else:
            labels = sources.groupBy("query_id").agg(F.collect_set("label").alias("labels"))
            rows = rows.join(labels, "query_id", "left").withColumn("labels", F.coalesce("labels", none)).join(answer.prompts(asked, sources), "query_id", "left")
        rows = rows.withColumn("answer", guardrails.strip_invalid(F.col("answer"), F.col("labels"))).withColumn("v", guardrails.verdict(F.col("answer"), F.col("labels"), self.settings.min_citation_coverage))
        count = lambda c: F.when(F.col("refused"), 0).otherwise(estimate_tokens(F.col(c))).cast("long")
        rows = rows.withColumn("model", F.lit("deterministic-extractive")).withColumn("tokens_in", count("prompt")).withColumn("tokens_out", count("answer"))
        rows = rows.withColumn("usd", answer.cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))
        trace = F.substring(F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), "question", answer.now()), 256), 1, 32)
        out = stages.written(rows.select("query_id", trace.alias("trace_id"), "question", "standalone", "route", "answer", "v.*", "model", "tokens_in", "tokens_out", "usd"), "answer")
        shown = sources if sources is not None else asked.select("query_id", *[F.lit(None).cast("string").alias(c) for c in ("label", "chunk_id", "title", "date", "text")], F.lit(0.0).alias("fused"), F.lit(False).alias("via_neighbour")).limit(0)
        self.store.save_traces(answer.traces(out, shown, stages.rows, {"embedding": "hashed-ngrams"}))
        return out

    def evaluate(self, cases: DataFrame, path: str | None = None) -> DataFrame:
        """The summary over evaluation cases as ``read_cases`` gives them; the outcomes go to ``path`` as JSON."""
        own = written(cases.select(F.col("id").alias("query_id"), F.col("question").alias("text"), F.col("mustRetrieve").alias("needles"), F.col("shouldMention").alias("mentions"), F.coalesce("expectRefusal", F.lit(False)).alias("expect_refusal")), "cases")
        sources, _ = self.retrieve(own.select("query_id", "text"))
        texts = sources.groupBy("query_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        judged = written(evaluate.outcomes(own, self.ask(own.select("query_id", "text")), texts), "outcomes")
        if path:
            judged.write.mode("overwrite").json(path)
        return evaluate.summary(judged)

    def ask_events(self, questions: DataFrame, path: str, scope: DataFrame | None = None) -> None:
        """Answer and write the events of each answer as JSON lines; where answering fails, each question gets an event that says so."""
        write_events(self.events(questions, scope), path)

    def events(self, questions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, seq, event) of the answers, or of the error that kept the questions from one."""
        try:
            answers = self.ask(questions, scope).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:
            none = F.lit(None).cast("string")
            message = (str(e).splitlines() or [type(e).__name__])[0][:500] or type(e).__name__
            answers = questions.select("query_id", none.alias("trace_id"), none.alias("route"), none.alias("standalone"), none.alias("answer"), F.lit(message).alias("error"))
        return answer.answer_events(answers)
