"""Near copies by exact shingle similarity: SimHash tiles give the first links, a prefix join completes them, every pair of Jaccard ``SIMILAR`` or more is found.

Rows of equal shingle sets are one node at once. Fingerprints of the nodes meet in the tiled comparison of ``simhash`` at RADIUS bits. 64 bits don't
separate a similarity of 0.8 from less, so the pairs of a prefix join follow: under any common order of the shingles, two sets of
similarity P / Q share one of their first n - ceil(n P / Q) + 1, and what comes after a shared shingle must suffice for the overlap. Rare shingles come first, by counts
in hashed cells; collisions change the order for all sets alike and lose nothing. In a first round, sets of a shared shingle meet the next
larger one only; the second compares those that the first has not joined, so that a large group of near copies costs no square.

Candidates are compared by parity bits of BITS positions: sets differ in as many shingles as bits at least, so exclusive-or and
bit counts drop most pairs and no similar one. The rest are verified over the whole sets, which are made anew for these texts only.
Each table between the steps is deleted, and the shuffles behind it are let go, as soon as no later step reads it.

Cases: a null text is an empty text; texts without a word are copies of each other; texts of fewer words than a shingle take their whole
word sequence; very long texts are taken whole, a batch holding one at least; repeated rows are copies, and of rows of equal id and text one
stays; of equal ids the text of least key counts as first; extra columns pass through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, connected_components, discard, giving_back, materialise, packed, raw, release, row_key
from colloquy.llm.simhash import SEED, fingerprint_of, near_links, shingle_hashes

#: Least similarity as a fraction, the words of a shingle and the bits within which fingerprints give a first link.
SIMILAR, WIDTH, RADIUS = (4, 5), 5, 3
#: Cells of the counts that order shingles, parity bits of a set, compared members of a group at a time, and members of a group that one task compares.
CELLS, BITS, SLAB, TILE = 1 << 20, 512, 256, 4096


def cell_counts(texts: DataFrame, width: int, hashes=shingle_hashes) -> np.ndarray:
    """How many distinct shingles of ``texts.text`` fall into each cell; a table of CELLS numbers whatever the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in raw(b.column(0)):
                np.add.at(n, (np.unique(hashes(t, width)) % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    found = texts.select("text").mapInArrow(giving_back(work), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def parity(hs: np.ndarray) -> bytes:
    """A bit for each position, set where an odd number of ``hs`` falls on it."""
    return np.packbits((np.bincount((hs >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def signed(texts: DataFrame, width: int, similar: tuple[int, int], hashes=shingle_hashes) -> DataFrame:
    """(id, k, s, n, fp, bits, lead) per row: s stands for the set of n shingles, ``lead`` holds its prefix in the common order. texts: (id, k, text)."""
    p, q = similar
    sent = texts.sparkSession.sparkContext.broadcast(cell_counts(texts, width, hashes))
    release(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for b in batches:
            s, n, fp, bits, lead = [], [], [], [], []
            for t in raw(b.column(2)):
                h = hashes(t, width)
                u = np.unique(h)
                s.append(xxhash.xxh64_intdigest(u.tobytes(), SEED))
                n.append(len(u))
                fp.append(fingerprint_of(h))
                bits.append(parity(u))
                first = np.argsort(counts[(u % np.uint64(CELLS)).astype(np.int64)], kind="stable")[: len(u) - -(-len(u) * p // q) + 1]
                lead.append(u[first].tobytes())
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), longs(s), pa.array(n, pa.int32()), longs(fp), pa.array(bits, pa.binary()), pa.array(lead, pa.binary())], ["id", "k", "s", "n", "fp", "bits", "lead"])

    return texts.mapInArrow(giving_back(work), f"id {kind}, k long, s long, n int, fp long, bits binary, lead binary")


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """(h, n, room, s): the prefix shingles that more than one set has; ``room`` counts the shingles from this one on. Sorted by h and n."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [np.frombuffer(x, np.int64) for x in raw(b.column(2))]
            sizes = np.fromiter(map(len, hs), np.int64, len(hs))
            n = np.repeat(b.column(1).to_numpy(), sizes)
            place = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cols = [np.concatenate([np.empty(0, np.int64), *hs]), n, (n - place).astype(np.int32), np.repeat(b.column(0).to_numpy(), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "n", "room", "s"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the next batch, with whether it equals the row before it
        held: pa.RecordBatch | None = None
        met = False
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            h = rows.column(0).to_numpy()
            same = h[1:] == h[:-1]
            keep = np.concatenate(([met], same)) | np.concatenate((same, [False]))
            yield rows.slice(0, len(h) - 1).filter(pa.array(keep[:-1]))
            held, met = rows.slice(len(h) - 1), bool(same[-1]) if len(same) else met
        if held is not None and met:
            yield held

    kind = "h long, n int, room int, s long"
    return nodes.select("s", "n", "lead").mapInArrow(spread, kind).repartition("h").sortWithinPartitions("h", "n", "s").mapInArrow(giving_back(shared), kind)


def _fits(n: np.ndarray, room: np.ndarray, m: np.ndarray, other: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m shingles may be similar: by their sizes, and by what each has from the shared shingle on."""
    p, q = similar
    return (np.maximum(n, m) * p <= np.minimum(n, m) * q) & (np.minimum(room, other) * (p + q) >= p * (n + m))


def _words(bits: pa.Array) -> np.ndarray:
    """Parity bits as rows of numbers."""
    return np.frombuffer(b"".join(raw(bits)), np.uint64).reshape(len(bits), -1)


def _close(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Whether parity bits differ in no more places than similar sets of so many shingles together do."""
    p, q = similar
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (p + q) <= (q - p) * sizes


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])


def neighbours(lead: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(u, v): sets next to each other in size among those that share a prefix shingle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]
        for b in batches:
            h, n, room, s = (np.concatenate((x, c.to_numpy().astype(np.int64))) for x, c in zip(last, b.columns))
            at = np.flatnonzero((h[1:] == h[:-1]) & _fits(n[1:], room[1:], n[:-1], room[:-1], similar))
            yield _pairs(s[at], s[at + 1])
            last = [c[-1:] for c in (h, n, room, s)]

    return lead.select("h", "n", "room", "s").mapInArrow(giving_back(work), "u long, v long")


def unjoined(rooted: DataFrame, nodes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(u, v): pairs of different roots among sets that share a prefix shingle, less those that parity bits part. A group over TILE sets is dealt out as pairs of tiles."""
    mixed = rooted.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("h", F.ceil(F.col("c") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int")
    dealt = rooted.join(mixed, "h").join(nodes.select("s", "bits"), "s").withColumn("t", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("h", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("z"), "t", "n", "room", "s", "root", "bits")

    def compared(cols: list[np.ndarray], cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t, n, room, s, root, bits = cols
        for a in range(0, len(n), SLAB):
            for c in range(a, len(n), SLAB):
                if n[c] * similar[0] > n[min(a + SLAB, len(n)) - 1] * similar[1]:
                    break  # sorted: later ones are larger
                x, y = slice(a, a + SLAB), slice(c, c + SLAB)
                ok = _fits(n[x, None], room[x, None], n[None, y], room[None, y], similar) & (root[x, None] != root[None, y])
                if cross:
                    ok &= t[x, None] != t[None, y]
                i, j = np.nonzero(np.triu(ok, 1) if a == c else ok)
                near = _close(bits[a + i], bits[c + j], n[a + i] + n[c + j], similar)
                yield s[a + i[near]], s[c + j[near]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in itertools.chain(batches, [None]):  # None: the last group is whole
            cols = held
            if b is not None:
                new = [*(c.to_numpy().astype(np.int64) for c in b.columns[:-1]), _words(b.columns[-1])]
                cols = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            if cols is None or not len(cols[0]):
                continue
            edge = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))))
            ends = np.append(edge[1:], len(cols[0]))
            last = len(edge) if b is None else len(edge) - 1
            for x, y in zip(edge[:last].tolist(), ends[:last].tolist()):
                if y - x > 1:
                    for u, v in compared([c[x:y] for c in cols[3:]], cols[1][x] != cols[2][x]):
                        out.append((u, v))
                        size += len(u)
                        if size > 1 << 18:
                            yield _pairs(*(np.concatenate(c) for c in zip(*out)))
                            out, size = [], 0
            held = [c[edge[-1] :] for c in cols]
        if size:
            yield _pairs(*(np.concatenate(c) for c in zip(*out)))

    return dealt.repartition("h", "a", "z").sortWithinPartitions("h", "a", "z", "n", "s").mapInArrow(giving_back(work), "u long, v long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similar: tuple[int, int], hashes=shingle_hashes) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar, materialised: those that parity bits don't part, by the sets of their texts."""
    p, q = similar

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            ok = pa.array(_close(_words(b.column(4)), _words(b.column(5)), n, similar))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(hashes(t, width)).tobytes() for t in raw(b.column(1))], pa.binary())], ["s", "hs"])

    def similar_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(raw(b.column(2)), raw(b.column(3)))]
            ok = pa.array([len(np.intersect1d(x, y, assume_unique=True)) * (p + q) >= p * (len(x) + len(y)) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    bits = lambda k: nodes.select(F.col("s").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"))
    met = pairs.distinct().join(bits("u"), "u").join(bits("v"), "v").select("u", "v", "nu", "nv", "bu", "bv")
    close = materialise(met.mapInArrow(giving_back(near), "u long, v long"), "close")
    release(nodes.sparkSession)
    wanted = close.select(F.explode(F.array("u", "v")).alias("s")).distinct().join(nodes.select("s", F.col("least.id").alias("_i"), F.col("least.k").alias("_k")), "s")
    there = texts.join(wanted, F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k"))).select("s", "text")
    sets = materialise(there.mapInArrow(giving_back(sets_of), "s long, hs binary").dropDuplicates(["s"]), "sets")
    release(nodes.sparkSession)
    own = lambda k: sets.select(F.col("s").alias(k), F.col("hs").alias(f"h{k}"))
    found = materialise(close.join(own("u"), "u").join(own("v"), "v").select("u", "v", "hu", "hv").mapInArrow(giving_back(similar_sets), "u long, v long"), "similar")
    discard(close, sets)
    return found


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v): sets of equal fingerprint with the least of them, and the least sets of linked fingerprints."""
    least = materialise(nodes.groupBy("fp").agg(F.min("s").alias("s")), "prints")
    equal = nodes.select("fp", F.col("s").alias("v")).join(least.withColumnRenamed("s", "u"), "fp").where("u <> v").select("u", "v")
    own = lambda k: least.select(F.col("fp").alias(f"f{k}"), F.col("s").alias(k))
    links = near_links(least, radius).toDF("fu", "fv").join(own("u"), "fu").join(own("v"), "fv").select("u", "v")
    return equal.union(links).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_links(nodes: DataFrame, lead: DataFrame, texts: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(u, v) over ``nodes.s``: similar pairs whose components are those of all similar pairs. ``lead`` is discarded."""
    first = verified(fingerprint_links(nodes, radius).union(neighbours(lead, similar)), nodes, texts, width, similar)
    release(nodes.sparkSession)
    roots = connected_components(first).withColumnRenamed("node", "s")
    rooted = materialise(lead.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "rooted")
    discard(lead, roots)
    rest = verified(unjoined(rooted, nodes, similar), nodes, texts, width, similar)
    discard(rooted)
    release(nodes.sparkSession)
    return first.union(rest)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of least id, null ids last."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "k")
    each = signed(texts, width, similar).groupBy("s").agg(F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bits").alias("bits"), F.first("lead").alias("lead"), F.min(order).alias("least"))
    prefixed = materialise(each, "prefixed")
    release(spark)
    lead, nodes = materialise(shared_prefixes(prefixed), "lead"), materialise(prefixed.drop("lead"), "nodes")
    discard(prefixed)
    release(spark)
    links = similar_links(nodes, lead, texts, width, similar)
    roots = connected_components(links).withColumnRenamed("node", "s")
    discard(links)
    first = nodes.select("s", "least").join(roots, "s", "left").groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("least").alias("f"))
    # rows of equal id and text are counted: only these few need a grouping of their own
    counted = texts.groupBy("id", "k").agg(F.count("*").alias("n")).withColumnsRenamed({"id": "_i", "k": "_k"})
    first = materialise(first.join(counted, F.col("f.id").eqNullSafe(F.col("_i")) & (F.col("f.k") == F.col("_k"))).select("_i", "_k", "n"), "first")
    discard(nodes, roots)
    release(spark)
    stay = packed(docs, id_col, text_col).join(first, F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k")))
    once = stay.where("n > 1").withColumn("place", F.row_number().over(Window.partitionBy("_i", "_k").orderBy(F.lit(1)))).where("place = 1")
    return stay.where("n = 1").select("r.*").union(once.select("r.*"))
