"""Time codes to milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hours and fraction are optional.
PATTERN = r"^(\d{1,3}):([0-5]\d)(?::([0-5]\d))?(?:[.,](\d{1,3}))?$"


def parse_timecode(c: Column) -> Column:
    """mm:ss or hh:mm:ss with an optional fraction; null if it is neither."""
    c = F.trim(c)
    part = lambda k: F.regexp_extract(c, PATTERN, k)
    number = lambda x: F.when(x == "", 0).otherwise(F.try_to_number(x, F.lit("999"))).cast("long")
    a, b, s = number(part(1)), number(part(2)), number(part(3))
    ms = number(F.rpad(part(4), 3, "0"))
    whole = F.when(part(3) == "", a * 60 + b).otherwise(a * 3600 + b * 60 + s)
    return F.when(c.rlike(PATTERN), whole * 1000 + F.when(part(4) == "", 0).otherwise(ms))


def format_timecode(ms: Column, hours: Column | None = None) -> Column:
    total = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    pad = lambda x: F.format_string("%02d", x.cast("long"))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    long = (h > 0) | (F.lit(False) if hours is None else hours)
    return F.when(ms.isNull(), "--:--").when(long, F.concat_ws(":", pad(h), pad(m), pad(s))).otherwise(F.concat_ws(":", pad(m), pad(s)))


def format_range(start: Column, end: Column) -> Column:
    hours = F.coalesce(end, start) >= 3_600_000
    one = format_timecode(start, hours)
    return F.when(start.isNull(), "no timestamp").when(end.isNull() | (end <= start), one).otherwise(F.concat(one, F.lit("–"), format_timecode(end, hours)))


def format_duration(ms: Column) -> Column:
    minutes = F.floor(ms / 60_000 + 0.5).cast("long")
    return F.when(ms.isNull() | (ms <= 0), "unknown").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), F.format_string("%02d", minutes % 60)))


def spoken_ms(text: Column) -> Column:
    """At 150 words a minute."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.floor(words / 150 * 60_000 + 0.5).cast("long")
