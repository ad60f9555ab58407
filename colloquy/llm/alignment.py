"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Each text is encoded twice, by a byte-level vocabulary (A) and a piece vocabulary (B), both over a blank and the text. The cumulative ends of both
token sequences are merged as by two pointers: an end of both closes a group, and every stretch between neighbouring ends is one A-B pair of
overlapping tokens, a link. Spark counts in how many documents each id pair is linked, takes the greatest count of each id, and joins
counts and maxima back to the documents.

Neither vocabulary has a token across a blank between two visible characters: both encode a text's chunks between such blanks one
by one. So a worker encodes and merges each distinct chunk once, all new ones of a slice of texts together, and puts a text together from its
chunks. It remembers a bounded number of chunks and hands on a slice's rows before it takes the next.

Pairs that a large share of the links have (over 1 / FEW of them, so under FEW pairs at any size) are joined by broadcast; the other pairs are
rare and meet their counts in a shuffle that no key can skew.

Cases: null and empty texts, and those that a vocabulary doesn't give back byte for byte (U+2581 stands for a blank in B), have no tokens: zeros and an
empty digest; strings of special tokens are plain text; very long texts are taken whole, chunk by chunk; repeated rows keep one output row each and
count as documents each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bpe import byte_letters, vocabulary_path
from colloquy.llm.common import bound_batches, give_back, giving_back, materialise

#: A blank between visible characters, where both vocabularies start a new token.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: How byte-level vocabularies part a text before their merges, a fixed value, and blanks too many in a row for one of the encoders.
A_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANK = re.compile(r"\s{1000}")
#: Bytes of chunks encoded at a time, an id pair as one number, and the pairs that are broadcast.
STEP, B_IDS, FEW = 1 << 20, 1 << 32, 100_000
#: Characters of texts taken at a time, and chunks beyond which a worker forgets those it met.
SLICE, KNOWN = 1 << 19, 100_000
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Tokens:
    """Both encoders, the byte length of each token, and the strings that write it into a group."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # where ids follow the order of the merges, they serve as the ranks of a faster encoder
        ranks = {self.a_bytes[i]: i for i in [*range(256), *merged]}
        in_order = merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged)
        self.fast_a = tiktoken.Encoding("a", pat_str=A_PIECES, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes across a blank: texts can't be cut there")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        a, b = range(len(self.a_bytes)), range(len(self.b_bytes))
        self.shown = [*(f"{i}," for i in a), *(f"{i}|" for i in a), *(f"{i}," for i in b), *(f"{i};" for i in b)]

    @cached_property
    def slow_a(self):
        """The file's own library, loaded where a text needs it."""
        import tokenizers

        out = tokenizers.Tokenizer.from_file(self.a_path)
        out.encode_special_tokens = True
        return out

    def encode_a(self, line: str) -> list[int]:
        if self.fast_a is None or LONG_BLANK.search(line):  # which overflow the faster encoder's stack
            return self.slow_a.encode(line, add_special_tokens=False).ids
        return self.fast_a.encode_ordinary(line)

    def encode(self, chunks: list[str]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Ids of a blank and each chunk by A and by B, one chunk after another, and how many each chunk has; none for a chunk that either doesn't give back.

        Chunks are encoded as one text, which falls into them again at their ends; where it doesn't give the chunks back, one by one.
        """
        line = " ".join(chunks)
        a, b = self.encode_a(" " + line), self.b.encode(line, num_threads=1)
        ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in chunks), np.int64, len(chunks)))
        whole = b" " + line.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            until = [np.searchsorted(x, ends) + 1 for x in (np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))]
            return a, b, *(np.diff(x, prepend=0) for x in until)
        if len(chunks) > 1:
            got = [self.encode([c]) for c in chunks]
            return *(list(chain.from_iterable(g[k] for g in got)) for k in (0, 1)), *(np.concatenate([g[k] for g in got]) for k in (2, 3))
        return [], [], np.zeros(1, np.int64), np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def tokens(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


class Merged:
    """The merge of two token sequences per text. Groups close at ``cuts``, where both have an end; link k joins the tokens ``link_a[k]`` and ``link_b[k]``."""

    def __init__(self, both: Tokens, chunks: list[str]):
        a, b, self.n_a, self.n_b = both.encode(chunks)
        self.a, self.b = np.array(a, np.int64), np.array(b, np.int64)
        # texts one after another: their borders are ends of both sides
        ends_a, ends_b = np.cumsum(both.a_sizes[self.a]), np.cumsum(both.b_sizes[self.b])
        ends = np.union1d(ends_a, ends_b)
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.last_a, self.last_b = np.searchsorted(ends_a, self.cuts), np.searchsorted(ends_b, self.cuts)
        text = np.repeat(np.arange(len(chunks)), self.n_a)
        self.n_links = np.bincount(text[self.link_a], minlength=len(chunks))
        self.n_groups = np.bincount(text[self.last_a], minlength=len(chunks))

    def pairs(self) -> np.ndarray:
        """Per link the id pair as one number."""
        return self.a[self.link_a] * B_IDS + self.b[self.link_b]

    def written(self, both: Tokens) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3;``: each group closed by a semicolon."""
        n, m = len(both.a_bytes), len(both.b_bytes)
        a, b = self.a.copy(), self.b + 2 * n
        a[self.last_a] += n
        b[self.last_b] += m
        # a token of a group stands after all tokens of earlier groups, A before B
        group_a, group_b = np.searchsorted(self.last_a, np.arange(len(a))), np.searchsorted(self.last_b, np.arange(len(b)))
        before_b, before_a = np.concatenate(([0], self.last_b + 1)), np.append(self.last_a + 1, len(a))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before_b[group_a]] = a
        out[np.arange(len(b)) + before_a[group_b]] = b
        shown = list(map(both.shown.__getitem__, out.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(shown[x:y]) for x, y in zip([0, *ends], ends)]


def steps(chunks: list[str]) -> Iterator[list[int]]:
    """Places of chunks to encode together. Those that a blank at an end or a blank's stand-in could join to others go alone."""
    part, size = [], 0
    for k, c in enumerate(chunks):
        if c[0].isspace() or c[-1].isspace() or "▁" in c or LONG_BLANK.search(c):
            yield [k]
            continue
        part.append(k)
        size += len(c)
        if size > STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


class Chunks:
    """Distinct chunks met lately, by their place: counts, groups as written, and where their links start."""

    def __init__(self, both: Tokens):
        self.both = both
        self.place: dict[str, int] = {}
        self.written: list[str] = []
        self.sums = {c: np.empty(0, np.int64) for c in COUNTS}
        self.starts = self.links = np.empty(0, np.int64)

    def places(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Per text the places of its chunks; the new ones are encoded and merged."""
        if len(self.place) > KNOWN:
            self.__init__(self.both)
            give_back()
        place, known = self.place, len(self.place)
        out = []
        for t in texts:
            cs = CUT.split(t) if t else []
            out.append(np.fromiter((place.setdefault(c, len(place)) for c in cs), np.int64, len(cs)))
        new = list(islice(place, known, None))
        self.written += [""] * len(new)
        sums, starts, links, met = {c: np.zeros(len(new), np.int64) for c in COUNTS}, np.zeros(len(new), np.int64), [self.links], len(self.links)
        for part in steps(new):
            m = Merged(self.both, [new[k] for k in part])
            for k, g in zip(part, m.written(self.both)):
                self.written[known + k] = g
            for c in COUNTS:
                sums[c][part] = getattr(m, c)
            starts[part] = met + np.cumsum(m.n_links) - m.n_links
            links.append(m.pairs())
            met += len(links[-1])
        self.sums = {c: np.concatenate([self.sums[c], sums[c]]) for c in COUNTS}
        self.starts, self.links = np.concatenate([self.starts, starts]), np.concatenate(links)
        return out

    def rows(self, f: pd.DataFrame) -> pd.DataFrame:
        """The rows of ``aligned`` for a frame of row, id and text."""
        own, sums = self.places(f["text"]), self.sums
        out = {"row": f["row"], "id": f["id"], **{c: np.zeros(len(f), np.int64) for c in COUNTS}, "groups": [""] * len(f), "pairs": [], "times": []}
        for k, at in enumerate(own):
            found = times = np.empty(0, np.int64)
            if len(at) and sums["n_a"][at].all():
                for c in COUNTS:
                    out[c][k] = sums[c][at].sum()
                out["groups"][k] = "".join([self.written[i] for i in at.tolist()])[:-1]
                # each distinct chunk's links once, with how often the chunk stands in the text
                chunk, n = np.unique(at, return_counts=True)
                sizes = sums["n_links"][chunk]
                where = np.repeat(self.starts[chunk] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                found, slot = np.unique(self.links[where], return_inverse=True)
                times = np.bincount(slot, np.repeat(n, sizes)).astype(np.int64)
            out["pairs"].append(found)
            out["times"].append(times)
        return pd.DataFrame(out)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, pairs, times) per document: its groups as text, its distinct linked id pairs and how often each is linked.

    A pair is a * 2^32 + b. vocabularies: files on every worker, of A and B; by default the installed ones.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = Chunks(tokens(*(vocabularies or (vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")))))
        for f in frames:
            size = np.cumsum([len(t) if t else 0 for t in f["text"]])
            for _, part in f.groupby(size // SLICE):
                yield chunks.rows(part)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(giving_back(work), f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, a_best, b_best) over distinct pairs: how many documents hold it linked, and the greatest such count of its A id and of its B id."""
    counts = materialise(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    counts = counts.select("pair", "n", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(B_IDS - 1)).alias("b"))
    best = lambda c: counts.groupBy(c).agg(F.max("n").alias(f"{c}_best"))
    return counts.join(best("a"), "a").join(best("b"), "b").select("pair", "n", "a_best", "b_best")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b), one row per document; n_best_b is n_best for the B ids."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = materialise(aligned(docs, id_col, text_col, vocabularies).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = materialise(pair_counts(rows), "pairs")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = lambda few: counts.where((F.col("n") * FEW >= total) if few else (F.col("n") * FEW < total))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = links.join(F.broadcast(known(True)), "pair", "left")
    sums = lambda df: df.groupBy("row").agg(*(F.sum(F.col("times") * F.when(F.col("n") == F.col(c), 1).otherwise(0)).alias(k) for k, c in (("n_best", "a_best"), ("n_best_b", "b_best"))), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rare = met.where("n is null").select("row", "pair", "times").join(known(False), "pair")
    found = sums(met.where("n is not null")).union(sums(rare)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(found, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_b"))
