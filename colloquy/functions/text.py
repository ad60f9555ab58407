"""Text scalars as columns; no user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that content terms leave out.
STOPWORDS = tuple(
    (
        "a about above after again against all am an and any are aren as at be because been before being below between both but by "
        "can cannot could couldn did didn do does doesn doing don down during each few for from further had hadn has hasn have haven "
        "having he her here hers herself him himself his how i if in into is isn it its itself just me more most much my myself no nor "
        "not of off on once only or other ought our ours ourselves out over own same shan she should shouldn so some such than that "
        "the their theirs them themselves then there these they this those through to too under until up very was wasn we were weren "
        "what when where which while who whom why will with won would wouldn you your yours yourself yourselves "
        "yeah yep okay ok um uh like really think thing things going got know right sure well actually basically maybe kind sort "
        "gonna wanna let lets us also even still back around one two three"
    ).split()
)

#: White space as the tests of this engine have it: ASCII and the no-break space.
WS = r"[\s\x{00A0}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"{WS}+", " "))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for null."""
    return F.coalesce(F.ceil(utf16_length(c) / 4), F.lit(0)).cast("long")


def distinct(c: Column) -> Column:
    """In the order of first occurrence."""
    return F.array_distinct(c)


def tokenize_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s'-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def content_terms(c: Column, limit: int = 24) -> Column:
    return F.slice(distinct(F.filter(tokenize_words(c), lambda w: F.length(w) > 2)), 1, limit)


def simple_terms(c: Column) -> Column:
    """Runs of letters and digits, lower-cased: the analyzer without stemming."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Split after . ! or ? where a capital, quote or bracket follows."""
    parts = F.split(F.regexp_replace(c, r"\n+", " "), r"(?<=[.!?])\s+(?=[A-Z\"'(\p{Lu}])")
    return F.filter(F.transform(parts, trim), lambda s: s != "")


def plain_sentences(c: Column) -> Column:
    """Split after . ! or ? whatever follows."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), trim), lambda s: s != "")


def normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", " ")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def capped(c: Column, n: int) -> Column:
    """The first ``n`` characters and a note of how many were left out."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("\n[… "), (F.length(c) - n).cast("string"), F.lit(" more characters]"))).otherwise(c)


def checksum(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def fnv1a(c: Column) -> Column:
    """FNV-1a over UTF-16 units, as an unsigned 32-bit number."""
    units = F.encode(c, "UTF-16BE")
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(units) / 2 - 1).cast("int"))
    code = F.transform(at, lambda i: F.conv(F.hex(F.substring(units, 2 * i + 1, F.lit(2))), 16, 10).cast("long"))
    code = F.when(F.length(c) > 0, code).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(code, F.lit(2166136261).cast("long"), lambda v, x: (v.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295)))


def ngrams(words: Column) -> Column:
    """Unigrams and bigrams of a word array."""
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))
