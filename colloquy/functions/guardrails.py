"""Questions, citations and answers judged by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import distinct, sentences, trim
from colloquy.settings import Settings

# Patterns, matched without regard to case. Word borders are ASCII ones.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
INJECTION = (
    r"ignore (?:all |the )?(?:previous|above|prior) instructions",
    r"disregard (?:all |the )?(?:previous|above|prior)",
    r"you are now (?:a|an) ",
    r"system prompt",
    r"reveal your (?:instructions|prompt)",
)
NON_ASSERTIVE = (
    r"^(here|that|this) (is|are|was|were)\b",
    r"^(i|we) (could not|couldn't|did not|didn't|cannot|can't|found no|don't)\b",
    r"^(nothing|no source|none of)\b",
    r"^(you (might|may|could)|try|consider|ask)\b",
    r"^(based on|according to) the (retrieved|provided|indexed)",
    r"^open the sources",
    r"\?$",
)
DECLINE = (
    r"\b(do|does|did) not (contain|include|mention|provide|cover|say|specify|discuss)\b",
    r"\b(no|not any) (information|mention|record|reference|discussion|detail)s? (about|on|regarding|of)\b",
    r"\bis not (mentioned|discussed|covered|addressed|stated|specified)\b",
    r"\b(cannot|can't|could not|couldn't) (find|answer|determine|tell)\b",
    r"\bnothing (in|about) the (excerpts|sources|transcripts?|meetings?)\b",
    r"\bI (could not|couldn't|did not|didn't) find\b",
)
WHOLE_MEETING = (
    r"\b(summar(y|ise|ize)|recap|overview|tl;?dr)\b",
    r"\b(all|every|each|full list of|complete list of)\s+(the\s+)?(decision|action|task|item|topic|question)",
    r"\bwhat (was|were|did we) (discussed|covered|talked about|go over)\b",
    r"\bminutes\b",
    r"\bwalk me through\b",
)
TIMECODE = r"\d{1,3}:[0-5]\d(?::[0-5]\d)?"
TIME_ITEM = rf"(?:at\s+)?{TIMECODE}(?:\s*[–—-]\s*{TIMECODE})?"
CITATION_ITEM = rf"(?:S\d+(?:\s+{TIME_ITEM})?|{TIME_ITEM})"
CITATION = rf"\[\s*{CITATION_ITEM}(?:\s*[,;]\s*{CITATION_ITEM})*\s*\]"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern.replace(r"\b", B))


def any_of(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(c, p)
    return out


def injection_hits(c: Column) -> Column:
    """The patterns that match."""
    return F.array_compact(F.array(*[F.when(matches(c, p), F.lit(p)) for p in INJECTION]))


def check_question(c: Column, limit: int = Settings.max_question_chars) -> Column:
    """Null if the question may be asked, else why not."""
    t = trim(c)
    return F.when(t == "", "The question is empty.").when(F.length(t) > limit, F.concat(F.lit("That question is "), F.length(t).cast("string"), F.lit(f" characters; the limit is {limit}. Please shorten it.")))


def whole_meeting_question(c: Column) -> Column:
    return any_of(c, WHOLE_MEETING)


def citation_items(marker: Column) -> Column:
    """Labels and times of one marker, in order; a label with its own time gives two."""
    parts = F.split(F.substring(marker, 2, F.length(marker) - 2), r"\s*[,;]\s*")
    parts = F.filter(F.transform(parts, trim), lambda p: p != "")
    pair = r"^(S\d+)\s+(.+)$"
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(pair), F.array(F.regexp_extract(p, pair, 1), F.regexp_extract(p, pair, 2))).otherwise(F.array(p))))


def citations(c: Column) -> Column:
    """Distinct labels in the order of first occurrence."""
    found = F.regexp_extract_all(c, F.lit(f"({CITATION})"), 1)
    return distinct(F.filter(F.flatten(F.transform(found, citation_items)), lambda p: p.rlike(r"^S\d+$")))


def assertive(c: Column) -> Column:
    return (F.size(F.split(c, r"\s+")) >= 4) & ~any_of(trim(c), NON_ASSERTIVE)


def declines(c: Column) -> Column:
    """Whether the first sentence declines to answer."""
    return any_of(F.coalesce(F.get(sentences(c), F.lit(0)), F.lit("")), DECLINE)


def verdict(answer: Column, labels: Column, least: float = Settings.min_citation_coverage) -> Column:
    """coverage, invalid citations, declined and flags of an answer whose sources have ``labels``."""
    cited = citations(answer)
    asserted = F.filter(sentences(answer), assertive)
    held = F.filter(asserted, lambda s: F.size(F.array_intersect(citations(s), labels)) > 0)
    coverage = F.when(F.size(asserted) == 0, 1.0).otherwise(F.size(held) / F.size(asserted))
    invalid, declined = F.array_except(cited, labels), declines(answer)
    flags = F.array_compact(F.array(
        F.when(F.size(labels) == 0, "no-evidence"), F.when(declined, "declined"), F.when(F.size(invalid) > 0, "invalid-citations"),
        F.when((F.size(labels) > 0) & ~declined & (coverage < least), "low-citation-coverage"),
    ))
    return F.struct(F.round(coverage, 2).alias("coverage"), invalid.alias("invalid"), declined.alias("declined"), flags.alias("flags"))


def strip_invalid(answer: Column, labels: Column) -> Column:
    """The answer without citations of unknown labels; a time goes with the label it follows."""
    mark = "\x01"
    marked = F.regexp_replace(answer, f"({CITATION})", f"{mark}$1{mark}")
    known = lambda x: F.array_contains(labels, x)
    is_label = lambda x: x.rlike(r"^S\d+$")

    def rewrite(token):
        items = citation_items(token)
        start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept"))
        step = lambda s, x: F.when(is_label(x), F.struct(known(x).alias("on"), F.when(known(x), F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept"))).otherwise(F.struct(s["on"].alias("on"), F.when(s["on"] | (F.size(s["kept"]) == 0), F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept")))
        kept = F.aggregate(items, start, step)["kept"]
        return F.when(F.size(kept) == F.size(items), token).when(F.exists(kept, is_label), F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))).otherwise("")

    parts = F.transform(F.split(marked, mark), lambda p, i: F.when(i % 2 == 1, rewrite(p)).otherwise(p))
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, ""), r"[ \t]{2,}", " "), r"\s+([.,;:])", "$1")


def no_evidence(question: Column, corpus_empty: Column) -> Column:
    # The two refusals.
    return F.when(corpus_empty, "There are no meetings indexed yet, so there is nothing for me to search. Upload a transcript, or load the sample corpus from the sidebar, and ask again.").otherwise(F.concat(F.lit('I could not find anything in the indexed meetings that speaks to "'), trim(question), F.lit('". Nothing scored above the relevance floor, so rather than guess: try naming a person, a project or a decision that would have come up, or widen the meeting selection in the sidebar.')))
