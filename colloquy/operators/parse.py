"""Transcripts to speaker turns: lines are classified by patterns, turns are islands of lines under window functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import collapse, distinct, trim
from colloquy.functions.timecode import parse_timecode, spoken_ms
from colloquy.sources.scratch import written

# The line grammar and the words that are no speakers or may stand in names.
CLOCK = r"\d{1,3}:[0-5]\d(?::[0-5]\d)?"
STAMP = CLOCK + r"(?:[.,]\d{1,3})?"
BRACKETED = rf"^[\[(]?\s*({STAMP})\s*[\])]?\s*[-–]?\s*([^:]{{1,60}}?)\s*:\s*(.*)$"
SPEAKER_FIRST = rf"^([^:\[(]{{1,60}}?)\s*[\[(]\s*({STAMP})\s*[\])]\s*:\s*(.*)$"
HEADING = rf"^(.{{1,60}}?)\s+({CLOCK})\s*$"
SPEAKER_ONLY = r"^([^:]{1,60}?)\s*:\s*(.*)$"
CUE = rf"^({STAMP})\s*-->\s*({STAMP})"
HEADER = r"(?i)^(title|date|meeting|participants|attendees|subject)\s*:\s*(.+)$"
BOILERPLATE = r"(?i)^transcript$|computer generated|change the text after|^recording\b"
NOT_A_SPEAKER = (
    "note", "notes", "action", "actions", "action item", "action items", "decision", "decisions", "agenda", "summary", "todo",
    "next steps", "attendees", "participants", "recording", "transcript", "warning", "http", "https",
)
PARTICLES = ("de", "del", "della", "van", "von", "der", "den", "du", "da", "di", "la", "le", "el", "bin", "al", "ibn")
#: Date layouts beside ISO; other spellings stay as they are.
DATE_LAYOUTS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy/M/d")


def speaker_like(c: Column) -> Column:
    t = trim(c)
    return (F.length(t).between(1, 60)) & ~F.lower(t).isin(*NOT_A_SPEAKER) & (F.size(F.split(t, r"\s+")) <= 5) & ~t.rlike(r"[.!?]$") & t.rlike(r"\p{L}")


def name_like(c: Column) -> Column:
    t = trim(c)
    words = F.split(t, r"\s+")
    each = F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(*PARTICLES))
    return F.length(t).between(1, 60) & (F.lower(t).eqNullSafe("unknown speaker") | ((F.size(words) <= 5) & each))


def clean_speaker(c: Column) -> Column:
    return trim(F.regexp_replace(collapse(c), r"^[-–*\s]+", ""))


def strip_tags(c: Column) -> Column:
    """A cue's text without its tags."""
    return trim(F.regexp_replace(c, "<[^>]+>", ""))


def normalise_date(c: Column) -> Column:
    """ISO date prefixes and known layouts as yyyy-MM-dd, anything else verbatim."""
    t = trim(c)
    known = [F.date_format(F.try_to_timestamp(t, F.lit(p)), "yyyy-MM-dd") for p in DATE_LAYOUTS]
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(t, F.lit(10))), *known, t)


def date_like(c: Column) -> Column:
    t = trim(c)
    return (F.length(t) <= 30) & t.rlike(r"\d") & normalise_date(t).rlike(r"^\d{4}-\d{2}-\d{2}$")


def to_lines(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, pos, line): line ends and no-break spaces normalised, lines trimmed."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\r\n?", "\n"), " ", " ")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("line", trim(F.col("line")))


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind: cue, bracketed, speaker-first, heading, speaker-only, other or blank, the first that fits."""
    x = F.col("line")
    kind = (
        F.when(x == "", "blank").when(x.rlike(CUE), "cue").when(x.rlike(BRACKETED), "bracketed").when(x.rlike(SPEAKER_FIRST), "speaker-first")
        .when(x.rlike(HEADING) & name_like(F.regexp_extract(x, HEADING, 1)), "heading").when(x.rlike(SPEAKER_ONLY), "speaker-only").otherwise("other")
    )
    return lines.withColumn("kind", kind)


def detect_format(lines: DataFrame) -> DataFrame:
    """(id, format) from classified lines."""
    n = lambda k: F.count_if(F.col("kind") == k)
    c = lines.groupBy("id").agg(n("cue").alias("c"), n("bracketed").alias("b"), n("speaker-first").alias("f"), n("heading").alias("h"), n("speaker-only").alias("o"), F.max(F.col("line").rlike(r"(?i)^WEBVTT(?![A-Za-z0-9_])")).alias("vtt"))
    said = (
        F.when(F.col("vtt") & (F.col("c") >= 1), "vtt").when(F.expr("c >= 2"), "srt").when(F.expr("b > 0 and b >= f and b >= h and b >= o"), "bracketed")
        .when(F.expr("f > 0 and f >= h and f >= o"), "speaker-first").when(F.expr("h >= 3 and h >= o"), "speaker-heading").when(F.expr("o > 0"), "plain").otherwise("unknown")
    )
    return c.select("id", said.alias("format"))


def split_header(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header: id, title, date, participants) and the lines below it: the block of header lines at the top, blanks aside."""
    cut = lines.where((F.col("line") != "") & ~F.col("line").rlike(HEADER)).groupBy("id").agg(F.min("pos").alias("cut"))
    marked = lines.join(cut, "id", "left").withColumn("top", F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
    key, value = F.lower(F.regexp_extract("line", HEADER, 1)), trim(F.regexp_extract("line", HEADER, 2))
    top = marked.where("top and line <> ''").select("id", "pos", key.alias("key"), value.alias("value"))
    last = lambda *keys: F.max_by(F.when(F.col("key").isin(*keys), F.col("value")), F.when(F.col("key").isin(*keys), F.col("pos")))
    said = F.array_sort(F.collect_list(F.when(F.col("key").isin("participants", "attendees"), F.struct("pos", "value"))))
    people = F.filter(F.flatten(F.transform(said, lambda x: F.transform(F.split(x["value"], "[,;]"), clean_speaker))), lambda p: p != "")
    header = top.groupBy("id").agg(last("title", "meeting", "subject").alias("title"), normalise_date(last("date")).alias("date"), people.alias("participants"))
    return header, marked.where("not top").drop("cut", "top")


def body_titles(lines: DataFrame) -> DataFrame:
    """(id, title, date) that the body itself gives: a cue file's NOTE, or what stands above the first heading. lines: with kind and format."""
    note = lines.where(F.col("format").isin("vtt", "srt") & F.col("line").rlike(r"^NOTE\s+\S")).groupBy("id").agg(F.min_by("line", "pos").alias("x"))
    dated = r"\s+[-–]\s+(\d{4}-\d{2}-\d{2})$"
    x = trim(F.regexp_replace("x", r"^NOTE\s+", ""))
    notes = note.select("id", trim(F.regexp_replace(x, dated, "")).alias("title"), F.nullif(F.regexp_extract(x, dated, 1), F.lit("")).alias("date"))
    top = lines.where("format = 'speaker-heading'").withColumn("first", F.min(F.when(F.col("kind") == "heading", F.col("pos"))).over(Window.partitionBy("id")))
    top = top.where((F.col("pos") < F.col("first")) & (F.col("line") != "") & ~F.col("line").rlike(BOILERPLATE))
    first_date = F.min(F.when(date_like(F.col("line")), F.col("pos"))).over(Window.partitionBy("id"))
    top = top.withColumn("dated", F.col("pos").eqNullSafe(first_date))
    heads = top.groupBy("id").agg(F.min_by(F.when(~F.col("dated"), F.col("line")), F.when(~F.col("dated"), F.col("pos"))).alias("title"), F.min_by(normalise_date(F.col("line")), F.when(F.col("dated"), F.col("pos"))).alias("date"))
    return notes.unionByName(heads)


def _islands(lines: DataFrame) -> DataFrame:
    """(id, island, speaker, start_ms, end_ms, parts): lines with ``opens`` begin an island; others go on with it."""
    w = Window.partitionBy("id").orderBy("pos")
    marked = lines.withColumn("island", F.sum(F.col("opens").cast("int")).over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    head = lambda c: F.min_by(c, F.when(F.col("opens"), F.col("pos")))
    return marked.groupBy("id", "island").agg(F.min("pos").alias("at"), head("speaker").alias("speaker"), head("start_ms").alias("start_ms"), head("end_ms").alias("end_ms"), ordered.alias("parts"))


def line_turns(lines: DataFrame) -> DataFrame:
    """Turns of bracketed, speaker-first and plain layouts; a line that names no speaker goes on with the turn before it."""
    x = F.col("line")
    get = lambda p, k: F.regexp_extract(x, p, k)
    fits = [x.rlike(p) & speaker_like(get(p, k)) for p, k in ((BRACKETED, 2), (SPEAKER_FIRST, 1), (SPEAKER_ONLY, 1))]
    pick = lambda a, b, c, other: F.when(fits[0], a).when(fits[1], b).when(fits[2], c).otherwise(other)
    body = lines.where((x != "") & ~x.rlike("(?i)^WEBVTT"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos")) == 1
    named = fits[0] | fits[1] | fits[2]
    rows = body.select(
        "id", "pos", (named | first).alias("opens"), pick(clean_speaker(get(BRACKETED, 2)), clean_speaker(get(SPEAKER_FIRST, 1)), clean_speaker(get(SPEAKER_ONLY, 1)), F.lit("Unknown")).alias("speaker"),
        pick(parse_timecode(get(BRACKETED, 1)), parse_timecode(get(SPEAKER_FIRST, 2)), F.lit(None), F.lit(None)).alias("start_ms"), F.lit(None).cast("long").alias("end_ms"),
        pick(trim(get(BRACKETED, 3)), trim(get(SPEAKER_FIRST, 3)), trim(get(SPEAKER_ONLY, 2)), x).alias("part"),
    )
    return _islands(rows)


def heading_turns(lines: DataFrame) -> DataFrame:
    """Turns under ``Name m:ss`` headings; text before the first is no turn."""
    opens = F.col("kind") == "heading"
    rows = lines.where("line <> ''").select("id", "pos", opens.alias("opens"), F.when(opens, clean_speaker(F.regexp_extract("line", HEADING, 1))).alias("speaker"), F.when(opens, parse_timecode(F.regexp_extract("line", HEADING, 2))).alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.when(opens, "").otherwise(F.col("line")).alias("part"))
    return _islands(rows).where("island > 0")


def cue_turns(lines: DataFrame) -> DataFrame:
    """Turns of WebVTT and SRT cues; a speaker's consecutive cues are one turn."""
    w = Window.partitionBy("id").orderBy("pos")
    cue = F.col("kind") == "cue"
    marked = lines.withColumn("n", F.sum(cue.cast("int")).over(w)).withColumn("shut", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(Window.partitionBy("id", "n").orderBy("pos")))
    parts = marked.where((F.col("n") > 0) & (F.col("shut") == 0) & ~cue & ~F.col("line").rlike(r"^\d+$")).groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("body"))
    heads = marked.where(cue).select("id", "n", "pos", parse_timecode(F.regexp_extract("line", CUE, 1)).alias("s"), parse_timecode(F.regexp_extract("line", CUE, 2)).alias("e"))
    voice, first = r"^<v\s+([^>]+)>\s*(.*)$", F.col("body")[0]
    named = first.rlike(SPEAKER_ONLY) & speaker_like(F.regexp_extract(first, SPEAKER_ONLY, 1))
    speaker = F.when(first.rlike(voice), clean_speaker(F.regexp_extract(first, voice, 1))).when(named, clean_speaker(F.regexp_extract(first, SPEAKER_ONLY, 1))).otherwise("Unknown")
    opening = F.when(first.rlike(voice), F.regexp_extract(first, voice, 2)).when(named, F.regexp_extract(first, SPEAKER_ONLY, 2)).otherwise(first)
    text = strip_tags(F.array_join(F.concat(F.array(opening), F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0)))), " "))
    cues = heads.join(parts, ["id", "n"]).select("id", "pos", "s", "e", speaker.alias("speaker"), text.alias("part")).where("part <> ''")
    opens = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    island = F.sum(F.col("opens").cast("int")).over(w)
    rows = cues.withColumn("opens", opens).withColumn("island", island)
    return rows.groupBy("id", "island").agg(F.min("pos").alias("at"), F.min_by("speaker", "pos").alias("speaker"), F.min_by("s", "pos").alias("start_ms"), F.when(F.count("*") >= 1, F.max_by("e", "pos")).alias("end_ms"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts"))


def finish_turns(turns: DataFrame) -> DataFrame:
    """(id, index, speaker, start_ms, end_ms, text): texts joined, empty turns dropped, open ends closed."""
    w = Window.partitionBy("id").orderBy("at")
    out = turns.withColumn("text", collapse(F.array_join("parts", " "))).where("text <> ''").withColumn("index", F.row_number().over(w) - 1)
    nxt = F.lead("start_ms").over(w)
    end = F.coalesce("end_ms", F.when(F.col("start_ms").isNotNull(), F.when(nxt > F.col("start_ms"), nxt).otherwise(F.col("start_ms") + spoken_ms(F.col("text")))))
    return out.withColumn("end_ms", end).select("id", F.col("index").cast("int").alias("index"), "speaker", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text")


def parse_turns(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, format, index, speaker, start_ms, end_ms, text) of transcripts of any layout."""
    _, body = split_header(to_lines(docs, id_col, text_col))
    body = written(classify(body), "lines")
    formats = written(detect_format(body), "formats")
    # only the layouts that occur are planned, as each brings sorts and windows of its own to every task
    kinds = {r.format for r in formats.select("format").distinct().collect()}
    ways = [(cue_turns, kinds & {"vtt", "srt"}), (heading_turns, kinds & {"speaker-heading"}), (line_turns, kinds - {"vtt", "srt", "speaker-heading"})]
    lines = body.join(formats, "id")
    turns = [read(lines.where(F.col("format").isin(*own)) if own != kinds else lines) for read, own in ways if own] or [line_turns(lines)]
    return finish_turns(written(reduce(DataFrame.unionByName, turns), "islands")).join(formats, "id").select("id", "format", "index", "speaker", "start_ms", "end_ms", "text")


def read_headers(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, title, date, participants) that a transcript itself gives: its header block, else its body; null where neither does."""
    top, body = split_header(to_lines(docs, id_col, text_col))
    body = classify(body)
    within = body_titles(body.join(detect_format(body), "id")).withColumnsRenamed({"title": "t", "date": "d"})
    both = top.join(within, "id", "full_outer")
    return both.select("id", F.coalesce(F.nullif("title", F.lit("")), "t").alias("title"), F.coalesce(F.nullif("date", F.lit("")), "d").alias("date"), "participants")


def participants(turns: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(id, participants): declared ones, then speakers in order of first word; ``Unknown`` aside."""
    heard = turns.where("speaker <> 'Unknown'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "speaker"))).alias("h")).select("id", distinct(F.transform("h", lambda x: x["speaker"])).alias("heard"))
    if declared is None:
        return heard.withColumnRenamed("heard", "participants")
    none = F.array().cast("array<string>")
    return heard.join(declared.select("id", F.col("participants").alias("said")), "id", "full_outer").select("id", distinct(F.concat(F.coalesce("said", none), F.coalesce("heard", none))).alias("participants"))


def warnings(turns: DataFrame) -> DataFrame:
    """(id, warnings): what the reader of a parsed transcript should know."""
    n = turns.groupBy("id", "format").agg(F.count("*").alias("n"), F.count("start_ms").alias("timed"), F.count_if((F.col("speaker") == "Unknown") & (F.col("index") == 0)).alias("orphans"))
    # The texts of the warnings.
    said = F.array_compact(F.array(
        F.when((F.col("orphans") > 0) & ~F.col("format").isin("vtt", "srt", "speaker-heading"), '1 line(s) had no recognisable speaker label and were attributed to "Unknown".'),
        F.when(F.col("format") == "unknown", "No speaker labels or timestamps recognised. Retrieval will still work but citations lose attribution."),
        F.when(F.col("timed") == 0, "No timestamps found. Answers will cite speakers but cannot link to a point in time.")
        .when(F.col("timed") < F.col("n") * 0.5, F.format_string("Only %d of %d turns carry a timestamp.", "timed", "n")),
    ))
    return n.select("id", said.alias("warnings"))


def title_from_filename(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(c, r"\.[^.]+$", ""), r"[_-]+", " ")
    rest = F.regexp_replace(base, r"^\d{4}[-\s]\d{2}[-\s]\d{2}\s*", "")
    t = trim(F.when(rest == "", base).otherwise(rest))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))


def date_from_filename(c: Column) -> Column:
    p = r"(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})"
    return F.date_format(F.try_to_timestamp(F.concat_ws("-", *[F.regexp_extract(c, p, k) for k in (1, 2, 3)]), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
