"""Personal data: base patterns, then bootstrapped contextual extraction.

The base patterns give the seed entities of four kinds; hash-like strings are seeds of a fifth, ``secret``. Every mention, a seed or
merely identifier-like (a token with a digit or an at sign), induces lexical patterns: the words before it, its label, the word behind it, with
digits and entities in the context generalised, and its own shape, alone or with a word or label. Spark aggregates the
(pattern, instance) graph and scores it in ROUNDS rounds. For a kind, a pattern has for it the scores of its distinct instances, against
it those of other kinds and those that a base check has refused (a card number that fails its check digit), and DOUBT of each unknown one; its confidence is
the Wilson lower bound of that share, so that support and specificity both count. An unknown instance's score follows from its confident patterns
(noisy or). In the end mentions in confident patterns become spans of that kind if they look like it, beside the base spans, which all stay.
Shape alone induces no pattern of secrets: hash-like strings are told only by their context.

Only narrow mention rows are shuffled, pattern sums aggregate before the shuffle, and the texts are read once.

Cases: a null text is empty; null and repeated ids keep a row each; repeated rows give the same spans, an instance counting once however
often it occurs; texts without a mention give zero counts and empty strings; kinds of equal confidence are taken in their order; very long texts are taken whole, in
linear time; other columns are ignored; an empty table gives no rows. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, materialise, strings

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans; the last is never a base span.
ALL = (*KINDS, "secret")
ROUNDS = 3
#: Confidence from which a pattern extracts, normal deviations of its lower bound, and what an unknown instance counts against a pattern.
CONFIDENT, DEVIATIONS, DOUBT = 0.75, 1.28, 0.25
#: An identifier-like token has this many characters at least.
LEAST = 5

# the base patterns; linear in the text where the plain form would try every start of a long run
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:\x20?[0-9]|-[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = "\"'`()[]{}<>,;:!?.#$%&*|"
_LETTERS = re.compile(r"[^\W\d_]+")
_HASH = re.compile(r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])[A-Za-z0-9_+/=-]{24,}")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not _HINT.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _word(token: str) -> str:
    return _DIGITS.sub("0", token.lower())


def shape(value: str) -> str:
    """Letters as one a, digit runs by their length, the rest as it is; hash-like strings as x."""
    return "x" if _HASH.fullmatch(value) else _DIGITS.sub(lambda m: f"<{min(len(m[0]), 20)}>", _LETTERS.sub("a", value))


def looks_like(value: str) -> list[str]:
    """The kinds that a value may be of by its characters; a value that a kind's own check refuses isn't of it."""
    digits, letters = sum(map(len, _DIGITS.findall(value))), bool(_LETTERS.search(value))
    out = ["email"] if "@" in value.strip("@") else []
    if "." in value and not letters and 4 <= digits <= 12 and not _DOTTED.fullmatch(value):
        out.append("ip")
    if not letters and 14 <= digits <= 19 and not _CARD.fullmatch(value):
        out.append("card")
    if not letters and 7 <= digits <= 15 and value[0] != "+":
        out.append("phone")
    return [*out, "secret"] if letters and digits and len(value) >= 16 else out


def refused(value: str) -> str | None:
    """The kind whose base pattern holds but not its check."""
    return "ip" if _DOTTED.fullmatch(value) else "card" if _CARD.fullmatch(value) and 14 <= sum(map(len, _DIGITS.findall(value))) <= 19 else "phone" if _PHONE.fullmatch(value) else None


def mentions(text: str, spans: list[tuple[str, int, int]] | None = None) -> list[tuple[int, int, str | None, str | None, list[str], int, list[str]]]:
    """(start, end, seed kind or None, refused kind or None, kinds it looks like, instance, patterns) of base spans and identifier-like tokens outside them."""
    base = base_spans(text) if spans is None else spans
    if not base and not _HINT.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    found: list[tuple[int, int, str | None, int, int]] = []
    k = 0
    held: dict[int, str] = {}  # tokens that an entity covers, by its kind
    for kind, a, b in base:
        while tokens[k][1] <= a:
            k += 1
        last = k
        while tokens[last][1] < b:
            last += 1
        found.append((a, b, kind, k, last))
        held |= dict.fromkeys(range(k, last + 1), f"<{kind}>")
    taken, at = sorted((a, b) for _, a, b in base), 0
    for k, (a, b) in enumerate(tokens):
        token = text[a:b]
        if len(token) < LEAST or not _HINT.search(token):
            continue
        cut = max(token.find("="), token.find(":")) + 1  # a label such as id= belongs to the context
        value = token[cut:]
        start = a + cut + len(value) - len(value.lstrip(_EDGE))
        end = b - len(value) + len(value.rstrip(_EDGE)) if value.strip(_EDGE) else start
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end - start >= LEAST and _HINT.search(text, start, end) and not (at < len(taken) and taken[at][0] < end):
            found.append((start, end, None, k, k))
    context = lambda k: held.get(k) or _word(text[slice(*tokens[k])])
    out = []
    for start, end, kind, first, last in found:
        one = context(first - 1) if first else "^"
        two = context(first - 2) if first > 1 else "^"
        after = context(last + 1) if last + 1 < len(tokens) else "$"
        value = text[start:end]
        label, own = _word(text[tokens[first][0] : start]), shape(value)
        patterns = [f"l {one} {label}", f"ll {two} {one} {label}", f"lr {one} {label} _ {after}", f"ls {one} {label} {own}", f"s {own}", f"s {re.sub('<[0-9]+>', '0', own)}"]
        if label:
            patterns += [f"in {label}", f"is {label} {own}"]
        seed = kind or ("secret" if _HASH.fullmatch(value) else None)
        if seed == "secret":
            patterns = [p for p in patterns if p[:2] != "s "]
        out.append((start, end, seed, None if kind else refused(value), [kind] if kind else looks_like(value), xxhash.xxh64_intdigest(value.lower().encode()) - (1 << 63), patterns))
    return out


_MENTION = "array<struct<start:long,end:long,kind:string,no:string,looks:array<string>,inst:long,patterns:array<string>>>"


def extract_mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mentions), one row per row of ``docs``."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("start", "end", "kind", "no", "looks", "inst", "patterns")
    made = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("no", pa.string()), ("looks", pa.list_(pa.string())), ("inst", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, m)) for m in mentions(t)] for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, made)], ["id", "mentions"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"id {kind}, mentions {_MENTION}")


def _wilson(hits, all_, z: float = DEVIATIONS):
    p = hits / all_
    return (p + z * z / (2 * all_) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / all_ + z * z / (4 * all_ * all_))) / (1 + z * z / all_)


def pattern_graph(each: DataFrame) -> DataFrame:
    """Distinct (pattern, inst, kind, no), materialised. each: one row per mention."""
    return materialise(each.select(F.explode("patterns").alias("pattern"), "inst", "kind", "no").groupBy("pattern", "inst").agg(F.max("kind").alias("kind"), F.max("no").alias("no")), "graph")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, conf) of confident patterns. edges: as ``pattern_graph`` gives them."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = edges.groupBy("pattern").agg(count(F.col("kind").isNull()).alias("unknown"), F.count("kind").alias("seeds"), *[count(F.col("kind") == k).alias(f"is_{k}") for k in ALL], *[count(F.col("kind").isNull() & (F.col("no") == k)).alias(f"no_{k}") for k in ALL])
    # a pattern without a seed says nothing in the first round; unknown instances may carry a score to it later
    least = next(n for n in range(1, 1000) if 1 / (1 + DEVIATIONS**2 / n) >= CONFIDENT)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"is_{k}").alias("own"), (F.col("seeds") - F.col(f"is_{k}")).alias("against"), (F.col("unknown") - F.col(f"no_{k}")).alias("open")) for k in ALL])).alias("x")
    sums = materialise(sums.where(F.col("unknown") + F.col("seeds") >= least).select("pattern", each).select("pattern", "x.*").where(F.col("own") + F.col("open") >= least), "sums")
    open_ = materialise(edges.where("kind is null").join(sums.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "inst", "no"), "open")
    told, confident = None, None
    for _ in range(rounds):
        now = sums.withColumn("told", F.lit(0.0))
        if told is not None:
            known = open_.join(told, "inst").where(F.coalesce(F.col("no") != F.col("kind"), F.lit(True))).groupBy("pattern", "kind").agg(F.round(F.sum("score"), 6).alias("told"))
            now = sums.join(known, ["pattern", "kind"], "left").withColumn("told", F.coalesce("told", F.lit(0.0)))
        hits = F.col("own") + F.col("told")
        conf = F.round(_wilson(hits, hits + F.col("against") + DOUBT * (F.col("open") - F.col("told"))), 6)
        confident = materialise(now.where(hits > 0).select("pattern", "kind", conf.alias("conf")).where(F.col("conf") >= CONFIDENT), "patterns")
        doubt = F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9))))
        told = materialise(open_.join(confident, "pattern").groupBy("inst", "kind").agg(F.round(1 - F.exp(doubt), 6).alias("score")), "told")
    return confident


def _extracted(each: DataFrame, confident: DataFrame) -> DataFrame:
    """(row, start, end, k): mentions in confident patterns, of the kind of the best one that they look like; k is the kind's place in ALL."""
    code = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(ALL)), F.lit(0))
    met = each.select("row", "start", "end", "looks", F.explode("patterns").alias("pattern")).join(confident, "pattern").where(F.expr("array_contains(looks, kind)"))
    return met.groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("conf")).alias("c"), code.alias("k"))).alias("best")).select("row", "start", "end", F.col("best.k").cast("int").alias("k"))


def _mention_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = materialise(extract_mentions(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "mentions")
    return rows, rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, base, found): arrays of (start, k, end), k the kind's place in ALL; ``base`` by the patterns, ``found`` by context."""
    rows, each = _mention_rows(docs, id_col, text_col)
    confident = score_patterns(pattern_graph(each), rounds)
    told = _extracted(each.where("kind is null or kind = 'secret'"), confident)
    told = told.groupBy("row").agg(F.collect_list(F.struct("start", "k", "end")).alias("found"))
    kinds = F.array(*map(F.lit, ALL))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] != "secret"), lambda m: F.struct(m["start"].alias("start"), (F.array_position(kinds, m["kind"]) - 1).cast("int").alias("k"), m["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    return rows.select("row", F.col("id").alias("_id"), F.array_sort(base).alias("base")).join(told, "row", "left").select(F.col("_id").alias(id_col), "base", F.array_sort(F.coalesce("found", none)).alias("found"))


def masked_recall(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """(kind, hidden, again, wrong): seeds hidden from learning (one distinct instance in ``share``), mentions of them found again as their kind, and found as another.

    ``kind`` is null for mentions that are no seeds; ``wrong`` then counts those found as anything.
    """
    _, each = _mention_rows(docs, id_col, text_col)
    hide = F.col("kind").isNotNull() & (F.pmod(F.xxhash64("inst"), F.lit(share)) == 0)
    masked = materialise(each.withColumn("truth", F.col("kind")).withColumn("hidden", hide).withColumn("kind", F.when(~hide, F.col("kind"))), "masked")
    got = _extracted(masked.where("kind is null"), score_patterns(pattern_graph(masked)))
    out = masked.where("hidden or truth is null").join(got, ["row", "start", "end"], "left")
    told = F.get(F.array(*map(F.lit, ALL)), "k")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return out.groupBy(F.col("truth").alias("kind")).agg(F.count("*").alias("hidden"), count(told == F.col("truth")).alias("again"), count(told.isNotNull() & ~F.coalesce(told == F.col("truth"), F.lit(False))).alias("wrong"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans of what ``find_pii`` gives."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL)), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    return found.select(
        id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans"),
    )
