"""Terms of questions, exact k-nearest neighbours, hashed embeddings and the stemming analyzer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import STOPWORDS, content_terms, simple_terms, tokenize_words
from colloquy.operators.leading import Leading, giving_back
from colloquy.operators.postings import top

#: Questions whose vectors go to the workers at a time, cells of a product of questions and vectors, of these such as are multiplied one by one
#: at a time, and the part of them from which on all are multiplied.
BROADCAST_QUERIES, CELLS, FEW, MANY = 8_000, 1 << 20, 4_096, 50
DIMENSIONS = 512
#: Texts whose grams are hashed at a time.
TEXTS = 500
#: What ``tokenize_words`` keeps of a text, and where it splits.
_KEPT, _SPACES = regex.compile(r"[\p{L}\p{N}\t\n\x0B\f\r '-]"), re.compile(r"[\t\n\x0B\f\r ]+")


def phrases(terms, analyzer=simple_terms):
    """Each term as the words that the analyzer makes of it, joined by blanks; terms without a word are left out."""
    return F.filter(F.transform(terms, lambda t: F.array_join(analyzer(t), " ")), lambda t: t != "")


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", terms=None) -> DataFrame:
    """(query_id, term, times); a term that two words of a query share counts twice. A term of several words, such as mi-412, is a phrase."""
    pick = terms or (lambda c: phrases(content_terms(c)))
    return queries.select(F.col(id_col).alias("query_id"), F.explode(pick(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def coverage_terms(queries: DataFrame, terms=simple_terms, text_col: str = "text") -> DataFrame:
    """(query_id, term, phrase): the content terms of each question as they are, and as the analyzer's words; its id column is query_id."""
    each = queries.select("query_id", F.explode(content_terms(F.col(text_col))).alias("term"))
    return each.withColumn("phrase", F.array_join(terms(F.col("term")), " "))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, score, rank): exact nearest neighbours by dot product. vectors: (id, vec); queries: (query_id, vec).

    Questions are asked in parts of about BROADCAST_QUERIES, numbered once by hash; each part is stacked once per worker. A task multiplies a bounded
    slice of vectors at a time and keeps a running best ``k`` per question, so what leaves a task doesn't grow with what it reads. The product is one of
    floats; only cells that it can't rule out, by the bound of its rounding, are multiplied as doubles.
    """
    rows = queries.select("query_id", "vec").where("vec is not null")
    parts = max(1, -(-rows.count() // BROADCAST_QUERIES))
    own = lambda part: rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
    found = [_nearest(vectors, own(part), k, least) for part in range(parts)]
    return top(reduce(DataFrame.unionByName, found), k)


def stacked(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the ids and the matrix of a bounded set of questions."""
    rows = queries.toArrow()
    names, column = rows["query_id"].to_numpy(zero_copy_only=False), rows["vec"].combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for size in set(sizes.tolist()):
        own = np.flatnonzero(sizes == size)
        out[size] = (names[own], column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float64).reshape(len(own), size))
    return out


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each task for each question."""
    by_size = {size: (names, matrix, matrix.astype(np.float32), np.sqrt((matrix**2).sum(1))) for size, (names, matrix) in stacked(queries).items()}

    def score(batches):
        best = {size: Leading(len(names), k, least, 0) for size, (names, *_) in by_size.items()}
        for pdf in batches:
            lengths = pdf["vec"].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for size, (names, matrix, rough, norms) in by_size.items():
                same = np.flatnonzero(lengths == size)
                step = max(1, CELLS // len(names))
                for a in range(0, len(same), step):
                    part = pdf.iloc[same[a : a + step]]
                    ids, vectors = part["id"].to_numpy(), np.stack(part["vec"].to_list()).astype(np.float32)
                    exact = vectors.astype(np.float64)
                    # a sum of n products of floats is off by at most n roundings of the product of both lengths
                    slack = (size + 2) * 2.0**-23 * norms * np.sqrt((exact**2).sum(1).max(initial=0)) + 1e-9
                    if not slack.max() < 1e20:  # out of the range of floats, or not a number
                        best[size].add(ids, np.round(matrix @ exact.T, 9))
                        continue
                    at, where = best[size].candidates(rough @ vectors.T, slack)
                    if len(at) > len(names) * len(ids) // MANY:  # one product is cheaper
                        best[size].put(at, ids[where], np.round((matrix @ exact.T)[at, where], 9))
                        continue
                    for c in range(0, len(at), FEW):
                        x, y = at[c : c + FEW], where[c : c + FEW]
                        best[size].put(x, ids[y], np.round(np.einsum("ij,ij->i", matrix[x], exact[y]), 9))
        for size, (names, *_) in by_size.items():
            rows = best[size].rows(names)
            if rows is not None:
                yield rows

    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    return vectors.select("id", "vec").mapInPandas(giving_back(score), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def fnv1a_of(texts: list[str]) -> np.ndarray:
    """FNV-1a over UTF-16 units of each text: the units at one place of all texts at a time."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64) for t in texts]
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    sizes = np.array([len(units[i]) for i in order], np.int64)
    flat, first = np.concatenate([np.empty(0, np.uint64), *[units[i] for i in order]]), np.cumsum(sizes) - sizes
    h = np.full(len(units), 2166136261, np.uint64)
    for at in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -at, "left"))  # the longer ones come first
        h[:n] = (h[:n] ^ flat[first[:n] + at]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(h)
    out[order] = h
    return out


def _cells(lists: list[list[str]], dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, value) of each word list: hashed unigrams and bigrams with a hashed sign, of unit length; empty without a word or where all cancels."""
    grams: dict[str, int] = {}
    each = [np.array([grams.setdefault(g, len(grams)) for g in [*w, *map(" ".join, zip(w, w[1:]))]], np.int64) for w in lists]
    names = list(grams)
    index = (fnv1a_of(names) % np.uint64(dimensions)).astype(np.int64)
    sign = np.where(fnv1a_of([f"{g}#" for g in names]) % np.uint64(2) == 0, 1.0, -1.0)
    for found in each:
        own, n = np.unique(found, return_counts=True)
        at = np.unique(index[own])
        v = np.bincount(np.searchsorted(at, index[own]), sign[own] * (1 + np.log(n)), len(at))
        norm = np.sqrt((v * v).sum())
        yield (at, v / norm) if norm > 1e-12 else (at[:0], v[:0])


def hash_embed(texts: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, index, value): hashed unigrams and bigrams with a hashed sign, of unit length; sparse rows."""
    kind = texts.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda x, t: pa.array(np.concatenate([np.empty(0, t), *x]).astype(t))
        for b in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            at, value = zip(*_cells([w or [] for w in b.column(1).to_pylist()], dimensions))
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), flat(at, np.int32), flat(value, np.float64)], ["id", "index", "value"])

    return texts.select(F.col(id_col).alias("id"), tokenize_words(F.col(text_col)).alias("w")).mapInArrow(giving_back(work), f"id {kind}, index int, value double")


def embed_texts(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """The same for a few texts in a task, as dense lists."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for k, (at, value) in enumerate(_cells([plain_words(t) for t in texts], dimensions)):
        out[k, at] = value
    return out.tolist()


def plain_words(text: str) -> list[str]:
    """``tokenize_words`` of one text."""
    low = "".join(c if _KEPT.match(c) else " " for c in text.lower())
    return [w for w in _SPACES.split(low) if len(w) > 1 and w not in STOPWORDS]


def hash_vectors(texts: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``texts`` with vec: the same as an array of all dimensions."""

    @F.pandas_udf("array<float>")
    def dense(words: pd.Series) -> pd.Series:
        out = np.zeros((len(words), dimensions), np.float32)
        for a in range(0, len(words), TEXTS):
            for k, (at, value) in enumerate(_cells([list(w) if w is not None else [] for w in words.iloc[a : a + TEXTS]], dimensions), a):
                out[k, at] = value
        return pd.Series(list(out))

    return texts.withColumn("vec", dense(tokenize_words(F.col(text_col))))


# --- the stemming analyzer: letters and digits, without accents, lower-cased, Porter-stemmed (Porter, 1980)


def _shape(w: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    s = _shape(w)
    return sum(a == "v" and b == "c" for a, b in zip(s, s[1:]))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffixes of steps 2, 3 and 4.
_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=1 << 18)  # distinct words of a worker, not occurrences
def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs, least in ((list(zip(_STEP2[::2], _STEP2[1::2])), 0), (_STEP3, 0)):
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


_WORD, _OTHER = re.compile(r"[^\W_]+"), re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 16)
def _bare(run: str) -> str:
    """A run of characters beyond ASCII without accents; ASCII around it neither changes it nor is changed."""
    return "".join(c for c in unicodedata.normalize("NFD", run) if not unicodedata.combining(c))


def cut_words(text: str) -> list[str]:
    plain = text if text.isascii() else _OTHER.sub(lambda m: _bare(m[0]), text)
    return _WORD.findall(plain.lower())


def stem_words(text: str) -> list[str]:
    return list(map(porter, cut_words(text or "")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_terms(texts: pd.Series) -> pd.Series:
    return texts.map(stem_words)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_phrases(terms: pd.Series) -> pd.Series:
    return terms.map(lambda each: [] if each is None else [p for p in (" ".join(stem_words(t)) for t in each) if p])
