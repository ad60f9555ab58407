"""N-gram Jaccard join: documents whose shingle sets are similar, by a blocked sparse matrix product.

The product of the document by n-gram incidence matrix with its transpose holds the overlap of every pair of documents. It is made in blocks of n-grams,
and only where a pair can still be similar. Documents of equal sets are one node. Under one order of the n-grams, rare ones first, sets of n
and m n-grams with Jaccard P / Q at least overlap in P (n + m) / (P + Q), of which all but a size-derived part lies in the prefixes
that enter the matrix. A block takes the postings of its n-grams, cut into slabs by size; an entry of the product is left out where sizes
or parity bits of the whole sets bound its overlap below what is needed. The blocks' partial overlaps are summed, pairs
below the size-derived bound go, and the others are multiplied over their whole rows.

Before the product a band of it is verified: sets next to each other in size under the same n-gram, those of equal size in an order of the n-gram's own. What this joins already counts as
one component, and the product skips pairs within components, so a large group of near copies costs no square. A posting list over TILE
sets is dealt out as pairs of tiles.

Cases: a null text, and one without a word, has an empty set and links with nothing, its own component; texts of fewer words than a shingle take their
whole word sequence; very long texts are taken whole; repeated rows keep one output row each; ids of a component that are all null give a null
component_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, connected_components, giving_back, materialise, release, row_key
from colloquy.llm.near_copies import SLAB, TILE, _close, _words, neighbours, shared_prefixes, signed, verified
from colloquy.llm.simhash import SEED

#: Least similarity as a fraction, and the words of a shingle.
SIMILAR, WIDTH = (9, 10), 3
#: Overlaps that a task sums up before it hands them on.
SUMMED = 1 << 18
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 200_000


#: Hashes of words met before, of one worker.
_WORDS: dict[bytes, int] = {}


def ngram_hashes(text: bytes, width: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of ``width`` words, lower-cased in A-Z, repeats included: the hashes of its words mixed in order. Fewer words make one n-gram."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > KNOWN_WORDS:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w, SEED)
    each = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ each[k : len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def prefix_size(n, similar: tuple[int, int]):
    """How many of n n-grams enter the matrix: all but so many that a similar set must meet one of these."""
    p, q = similar
    return n - -(-n * p // q) + 1


def least_overlap(n: np.ndarray, m: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """The overlap of prefixes that similar sets of n and m n-grams have at least.

    They share ceil(P (n + m) / (P + Q)). Beyond the prefix that ends first lie at most as many as its set has left.
    """
    p, q = similar
    whole = -(-(n + m) * p // (p + q))
    return np.maximum(1, whole - np.maximum(n - prefix_size(n, similar), m - prefix_size(m, similar)))


def _overlaps(u: np.ndarray, v: np.ndarray, n: np.ndarray, m: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Partial overlaps summed by pair, the lesser set first."""
    turn = u > v
    u, v, n, m = np.where(turn, v, u), np.where(turn, u, v), np.where(turn, m, n), np.where(turn, n, m)
    order = np.lexsort((v, u))
    u, v, n, m, c = (x[order] for x in (u, v, n, m, c))
    first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))) if len(u) else np.empty(0, np.int64)
    return [u[first], v[first], n[first], m[first], np.add.reduceat(c, first) if len(u) else c]


def product(lead: DataFrame, nodes: DataFrame, roots: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(u, v, n, m, c): c prefix n-grams that the sets u and v of n and m n-grams share, for pairs of different roots, less those that their bounds rule out.

    A block takes the n-grams whose least set is the same: those of one family of texts, whose overlaps so sum up in one task.
    """
    rooted = materialise(lead.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "rooted")
    mixed = rooted.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("z"), F.min("s").alias("block")).where("a <> z").select("h", "block", F.ceil(F.col("c") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int")
    dealt = rooted.join(mixed, "h").join(nodes.select("s", "bits"), "s").withColumn("t", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("block", "h", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("z"), "t", "n", "s", "root", "bits")

    def block(cols: list[np.ndarray], cross: bool) -> Iterator[list[np.ndarray]]:
        """One posting list's part of the product, slab by slab."""
        t, n, s, root, bits = cols
        for a in range(0, len(n), SLAB):
            for c in range(a, len(n), SLAB):
                if n[c] * similar[0] > n[min(a + SLAB, len(n)) - 1] * similar[1]:
                    break  # sorted: later ones are larger
                x, y = slice(a, a + SLAB), slice(c, c + SLAB)
                ok = (np.maximum(n[x, None], n[None, y]) * similar[0] <= np.minimum(n[x, None], n[None, y]) * similar[1]) & (root[x, None] != root[None, y])
                if cross:
                    ok &= t[x, None] != t[None, y]
                i, j = np.nonzero(np.triu(ok, 1) if a == c else ok)
                near = _close(bits[a + i], bits[c + j], n[a + i] + n[c + j], similar)
                i, j = a + i[near], c + j[near]
                yield [s[i], s[j], n[i], n[j], np.ones(len(i), np.int64)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        sums: list[list[np.ndarray]] = []
        size, full = 0, SUMMED

        def summed() -> list[np.ndarray]:
            return _overlaps(*(np.concatenate(c) for c in zip(*sums)))

        named = lambda cols: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "v", "n", "m", "c"])
        for b in itertools.chain(batches, [None]):  # None: the last list is whole
            cols = held
            if b is not None:
                new = [*(c.to_numpy().astype(np.int64) for c in b.columns[1:-1]), _words(b.columns[-1])]
                cols = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            if cols is None or not len(cols[0]):
                continue
            edge = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))))
            ends = np.append(edge[1:], len(cols[0]))
            last = len(edge) if b is None else len(edge) - 1
            for x, y in zip(edge[:last].tolist(), ends[:last].tolist()):
                if y - x > 1:
                    for part in block([c[x:y] for c in cols[3:]], cols[1][x] != cols[2][x]):
                        sums.append(part)
                        size += len(part[0])
                        if size > full:
                            sums = [summed()]
                            size = len(sums[0][0])
                            if size > SUMMED // 2:  # few pairs repeat in this block: the next step sums them up
                                yield named(sums[0])
                                sums, size = [], 0
            held = [c[edge[-1] :] for c in cols]
        if sums:
            yield named(summed())

    return dealt.repartition("block", "a", "z").sortWithinPartitions("block", "h", "a", "z", "n", "s").mapInArrow(giving_back(work), "u long, v long, n long, m long, c long")


def overlapping(parts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(u, v): pairs whose partial overlaps reach, in sum, what similar sets of their sizes share in their prefixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, c = (b.column(k).to_numpy() for k in (2, 3, 4))
            ok = pa.array(c >= least_overlap(n, m, similar))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    return parts.groupBy("u", "v").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("c").alias("c")).mapInArrow(giving_back(work), "u long, v long")


def jaccard_links(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(u, v) over ``nodes.s``: similar pairs whose components are those of all similar pairs."""
    spark = nodes.sparkSession
    lead = materialise(shared_prefixes(nodes), "lead")
    release(spark)
    # next to each other in an order of its own under each n-gram, so that a group of near copies meets in many pairs
    mixed = lead.repartition("h").sortWithinPartitions("h", "n", F.xxhash64("h", "s"))
    band = verified(neighbours(mixed, similar), nodes, texts, width, similar, ngram_hashes)
    roots = connected_components(band).withColumnRenamed("node", "s")
    rest = overlapping(product(lead, nodes, roots, similar), similar)
    return band.union(verified(rest, nodes, texts, width, similar, ngram_hashes))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(signed(texts, width, similar, ngram_hashes), "ngram-rows")
    least = F.struct(F.col("id").isNull().alias("last"), "id", "k")
    nodes = materialise(rows.where("n > 0").groupBy("s").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("lead").alias("lead"), F.min(least).alias("least")), "ngram-nodes")
    roots = connected_components(jaccard_links(nodes, texts, width, similar)).withColumnRenamed("node", "s")
    classes = nodes.select("s", F.col("least.id").alias("id")).join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
    first = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialise(classes.select("s", "root").join(first, "root").select("s", "component_id"), "ngram-classes")
    out = rows.where("n > 0").select("id", "n", "s").join(named, "s").select("id", "n", "component_id")
    return out.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
