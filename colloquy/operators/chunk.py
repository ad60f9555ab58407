"""Turns to overlapping chunks of a token budget: one fold per meeting inside Catalyst, or pointer jumping for meetings of very many turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import distinct, estimate_tokens, plain_sentences
from colloquy.functions.timecode import format_timecode
from colloquy.settings import Settings
from colloquy.sources.scratch import written

#: Turns up to which a meeting's windows are one fold, which copies its state each turn.
FOLDED = 2000


def rendered(hours: bool = True):
    """``[hh:mm:ss] Speaker: text``, or without the stamp where there is none."""
    body = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    return F.when(F.col("start_ms").isNull(), body).otherwise(F.concat(F.lit("["), format_timecode(F.col("start_ms"), F.lit(hours)), F.lit("] "), body))


def split_long_turns(turns: DataFrame, max_tokens: int = Settings.chunk_max_tokens) -> DataFrame:
    """Turns over ``max_tokens`` in pieces of whole sentences; adds piece. A single longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, x):
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        full = (s["open"] != "") & (estimate_tokens(joined) > max_tokens)
        return F.when(full, F.struct(F.array_append(s["done"], s["open"]).alias("done"), x.alias("open"))).otherwise(F.struct(s["done"].alias("done"), joined.alias("open")))

    packed = F.aggregate(plain_sentences(F.col("text")), start, step, lambda s: F.array_append(s["done"], s["open"]))
    pieces = F.when(estimate_tokens(F.col("text")) > max_tokens, packed).otherwise(F.array("text"))
    rest = [c for c in turns.columns if c != "text"]
    return turns.select(*rest, F.posexplode(pieces).alias("piece", "text"))


def chunk_windows(turns: DataFrame, target: int = Settings.chunk_target_tokens, overlap: int = Settings.chunk_overlap_tokens) -> DataFrame:
    """(id, ordinal, first, last): windows over the ``n``-th costs of each meeting. turns: (id, n, cost), n from 0 without gaps.

    A window closes before the turn that would exceed ``target``; the next one carries the trailing turns that fit ``overlap``, unless
    that is the whole window. Meetings of over FOLDED turns take ``jumped_windows``, which gives the same.
    """
    long = turns.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") > FOLDED).select("id")
    if not long.take(1):
        return folded_windows(turns, target, overlap)
    long = written(long, "long")
    many = jumped_windows(turns.join(long, "id", "left_semi"), target, overlap)
    return folded_windows(turns.join(long, "id", "left_anti"), target, overlap).unionByName(many)


def folded_windows(turns: DataFrame, target: int, overlap: int) -> DataFrame:
    """The windows as one fold per meeting. Its state is the window's start; prefix sums give the costs."""
    costs = F.transform(F.array_sort(F.collect_list(F.struct("n", "cost"))), lambda x: x["cost"])
    meetings = turns.groupBy("id").agg(costs.alias("c"))
    sums = F.aggregate("c", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    meetings = meetings.withColumn("pre", sums)
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(state, i):
        s, pre = state["s"], F.col("pre")
        full = (i > s) & (F.get(pre, i + 1) - F.get(pre, s) > target)
        fits = F.filter(F.sequence(s, i), lambda k: F.get(pre, i) - F.get(pre, k) <= overlap)
        first = F.coalesce(F.get(fits, F.lit(0)), i)
        carry = F.when(first == s, i).otherwise(first)
        return F.when(full, F.struct(carry.alias("s"), F.array_append(state["done"], F.struct(s.alias("first"), (i - 1).alias("last"))).alias("done"))).otherwise(state)

    n = F.size("c")
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.array_append(s["done"], F.struct(s["s"].alias("first"), (n - 1).alias("last"))))
    return meetings.select("id", F.posexplode(folded).alias("ordinal", "w")).select("id", "ordinal", "w.first", "w.last")


def window_steps(turns: DataFrame, target: int, overlap: int) -> DataFrame:
    """(id, node, first, last, next): the windows that may be, and which one follows; null after the last turn.

    The turn ``i`` that a window has no room for opens the next one, alone (node 2 i) or behind the turns that it carries (node 2 i + 1). How far a
    window reaches and what it carries are as-of lookups in the running sums, made by sorting marks and questions together.
    """
    w = Window.partitionBy("id").orderBy("n")
    sums = turns.select("id", F.col("n").cast("int").alias("n"), F.sum("cost").over(w).alias("hi"), (F.sum("cost").over(w) - F.col("cost")).alias("lo"))
    row = lambda at, kind, mark, ask: F.struct(at.alias("at"), F.lit(kind).alias("kind"), mark.cast("int").alias("mark"), ask.cast("int").alias("ask"))
    none = F.lit(None).cast("int")
    # the last turn whose end is within the target of the start; marks come before questions of equal sum
    ends = sums.select("id", F.explode(F.array(row(F.col("hi"), 0, F.col("n"), none), row(F.col("lo") + target, 1, none, F.col("n")))).alias("x")).select("id", "x.*")
    far = ends.withColumn("far", F.max("mark").over(Window.partitionBy("id").orderBy("at", "kind"))).where("ask is not null").select("id", F.col("ask").alias("n"), F.greatest("far", "ask").alias("far"))
    # the first turn from whose start to a turn's start no more than the overlap lies; in falling order, marks before questions of equal sum
    starts = sums.select("id", F.explode(F.array(row(F.col("lo"), 1, F.col("n"), none), row(F.col("lo") - overlap, 0, none, F.col("n")))).alias("x")).select("id", "x.*")
    after = Window.partitionBy("id").orderBy(F.desc("at"), F.desc("kind"))
    back = starts.withColumn("back", F.min("mark").over(after)).where("ask is not null").select("id", F.col("ask").alias("n"), F.least(F.coalesce("back", "ask"), "ask").alias("back"))
    known = written(far.join(back, ["id", "n"]), "reach")
    alone = known.select("id", (2 * F.col("n")).alias("node"), F.col("n").alias("first"), F.col("far").alias("last"))
    carried = known.select("id", F.col("n").alias("i"), F.col("back").alias("n")).join(far, ["id", "n"]).select("id", (2 * F.col("i") + 1).alias("node"), F.col("n").alias("first"), F.greatest("i", "far").alias("last"))
    each = alone.unionByName(carried).withColumn("n", F.col("last") + 1)
    return each.join(known.select("id", "n", "back"), ["id", "n"], "left").select("id", "node", "first", "last", F.when(F.col("back") <= F.col("first"), 2 * F.col("n")).when(F.col("back").isNotNull(), 2 * F.col("n") + 1).alias("next"))


def jumped_windows(turns: DataFrame, target: int, overlap: int) -> DataFrame:
    """The windows by pointer jumping: those that the first one reaches, found by doubling each one's step; as many rounds as the logarithm of the windows."""
    steps = written(window_steps(turns, target, overlap), "steps")
    jump = steps.where("next is not null").select("id", "node", F.col("next").alias("to"))
    reached = steps.where("node = 0").select("id", "node")
    while jump.take(1):
        more = reached.join(jump, ["id", "node"]).select("id", F.col("to").alias("node"))
        reached = written(reached.union(more), "reached")
        jump = written(jump.join(jump.select("id", F.col("node").alias("to"), F.col("to").alias("then")), ["id", "to"]).select("id", "node", F.col("then").alias("to")), "jump")
    place = F.row_number().over(Window.partitionBy("id").orderBy("node")) - 1
    return reached.join(steps, ["id", "node"]).select("id", place.alias("ordinal"), "first", "last")


def chunk_transcript(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, ordinal, text, speakers, start_ms, end_ms, first_turn_index, last_turn_index, token_count). turns: id, index, speaker, start_ms, end_ms, text."""
    pieces = split_long_turns(turns, settings.chunk_max_tokens).withColumn("line", rendered()).withColumn("cost", estimate_tokens(F.col("line")))
    pieces = pieces.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("index", "piece")) - 1)
    windows = chunk_windows(pieces, settings.chunk_target_tokens, settings.chunk_overlap_tokens)
    return drop_trailing_duplicates(materialise_chunks(pieces, windows))


def materialise_chunks(pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """Texts and bounds of windows: each window's turns meet it by equality on the turn number."""
    each = windows.select("id", "ordinal", F.explode(F.sequence("first", "last")).alias("n")).join(pieces, ["id", "n"])
    rows = F.array_sort(F.collect_list(F.struct("n", "line", "speaker")))
    return (
        each.groupBy("id", "ordinal").agg(rows.alias("r"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("index").alias("first_turn_index"), F.max("index").alias("last_turn_index"))
        .withColumn("text", F.array_join(F.transform("r", lambda x: x["line"]), "\n")).withColumn("speakers", distinct(F.transform("r", lambda x: x["speaker"])))
        .withColumn("token_count", estimate_tokens(F.col("text"))).drop("r")
    )


def drop_trailing_duplicates(chunks: DataFrame) -> DataFrame:
    """Without a last chunk that the one before contains."""
    w = Window.partitionBy("id").orderBy("ordinal")
    marked = chunks.withColumn("_before", F.lag("text").over(w)).withColumn("_next", F.lead("ordinal").over(w))
    return marked.where(~(F.col("_next").isNull() & F.coalesce(F.contains("_before", "text"), F.lit(False)))).drop("_before", "_next")


def header(title, date, speakers):
    return F.concat(F.lit('Meeting "'), title, F.lit('"'), F.coalesce(F.concat(F.lit(" on "), date), F.lit("")), F.lit(". Speakers: "), F.array_join(speakers, ", "), F.lit("."))


def segment_lines(texts: DataFrame, budget: int = 3000, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, text): lines packed into segments of ``budget`` tokens, without overlap; a longer line stands alone."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("cost", estimate_tokens(F.col("line")))
    windows = chunk_windows(lines, budget, -1)
    each = windows.select("id", "ordinal", F.explode(F.sequence("first", "last")).alias("n")).join(lines, ["id", "n"])
    return each.groupBy("id", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
