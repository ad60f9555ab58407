"""SimHash near-duplicates by tiled exact comparison.

A fingerprint holds 64 bits, each set where over half the text's shingle hashes set it. Rows of
equal fingerprint are one class at once, so copies cost one comparison partner however many
they are. Two fingerprints within ``radius`` bits agree in one of ``radius + 1`` blocks of the 64 bits, or in
``a`` of ``radius + a`` (pigeonhole), so each fingerprint goes to one bucket per choice of blocks and no link is lost. In a bucket,
fingerprints sorted by population count form tiles; a tile pair whose counts differ by more than the
radius is skipped, others are compared in full with numpy exclusive-or and bit counts. Buckets
above ``TILE`` rows are dealt out as tile pairs, so no task holds an unbounded bucket.
Each comparison gives a spanning forest of its links rather than all pairs; components follow from
the union of these forests.

Cases: a null text is an empty text; texts without a word have fingerprint zero and link like any other;
texts of fewer words than a shingle take their whole word sequence; repeated rows keep one output row each; a component
whose ids are all null has a null component_id; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, connected_components, materialise, packed, raw, row_key

#: Rows of a tile; a matrix of TILE x TILE comparisons is held at a time.
TILE = 1024
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, lower-cased in A-Z, repeats included."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, k, fp): fp as a signed long, one row per row of ``docs``; k stands for the text."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in raw(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "k", "fp"])

    return docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("k"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"id {kind}, k long, fp long")


def forest(fp: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of ``fp`` (uint64, distinct) as their pairs within ``radius`` do, at most one per member."""
    counts = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    fp, counts = fp[order], counts[order]
    root = np.arange(len(fp))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    for i in range(0, len(fp), tile):
        for j in range(i, len(fp), tile):
            if counts[j] - counts[min(i + tile, len(fp)) - 1] > radius:
                break  # sorted: later tiles differ by more
            near = np.bitwise_count(fp[i : i + tile, None] ^ fp[None, j : j + tile]) <= radius
            for a, b in zip(*np.nonzero(np.triu(near, 1) if i == j else near)):
                if (p := find(i + int(a))) != (q := find(j + int(b))):
                    root[max(p, q)] = min(p, q)
                    out.append((i + int(a), j + int(b)))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def _runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Compare within each run of equal (block, value, tile pair); a run may go on in the next batch."""
    names = ["u", "v"]
    held: list[np.ndarray] = []
    key: tuple | None = None

    def done() -> Iterator[pa.RecordBatch]:
        if sum(map(len, held)) > 1:
            a, b = forest(np.unique(np.concatenate(held)), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        fp = np.ascontiguousarray(cols[4]).view(np.uint64)
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
        at = [0, *change.tolist(), len(fp)]
        firsts = list(zip(*[c[at[:-1]].tolist() for c in cols[:4]]))
        for k, a, b in zip(firsts, at[:-1], at[1:]):
            if k != key:
                yield from done()
                held, key = [], k
            held.append(fp[a:b])
    yield from done()


def near_links(nodes: DataFrame, radius: int, agree: int | None = None) -> DataFrame:
    """(u, v) over the distinct fingerprints ``nodes.fp``: links whose components are those of all pairs within ``radius`` bits.

    Of ``radius + agree`` blocks, two such fingerprints share ``agree`` at least; each choice of so many blocks is a
    bucket key. Every ``agree`` gives the same links; more fingerprints take a larger one, for keys of enough bits.
    """
    if agree is None:
        bits = math.log2(max(2, nodes.count())) - 4
        agree = next(a for a in range(1, 64) if a * 64 / (radius + a) >= bits or a == 4)
    blocks = radius + agree
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen) for chosen in itertools.combinations(range(blocks), agree)]
    keys = F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("x")) for i, m in enumerate(masks)])
    dealt = nodes.select("fp", F.bit_count("fp").alias("pc"), F.explode(keys).alias("k")).select("k.b", "k.x", "pc", "fp")
    # tiles of a large bucket: by population count, then by hash so that none exceeds TILE by much
    tiles = dealt.groupBy("b", "x", "pc").agg(F.count("*").alias("n"))
    large = tiles.groupBy("b", "x").agg(F.sum("n").alias("all"), F.collect_list(F.struct("pc", F.ceil(F.col("n") / TILE).alias("s"))).alias("tiles")).where(f"all > {2 * TILE}")
    own = F.expr("pc * 1000000L + pmod(xxhash64(fp, 7), get(filter(tiles, t -> t.pc = pc), 0).s)")
    near = F.expr(f"flatten(transform(filter(tiles, t -> abs(t.pc - pc) <= {radius}), t -> transform(sequence(0L, t.s - 1), i -> t.pc * 1000000L + i)))")
    split = (
        dealt.join(large, ["b", "x"], "left").withColumn("t", F.when(F.col("tiles").isNotNull(), own)).withColumn("o", F.when(F.col("tiles").isNotNull(), near))
        .select("b", "x", "t", "fp", F.explode(F.coalesce("o", F.array(F.lit(-1).cast("long")))).alias("o"))
        .select("b", "x", F.coalesce(F.least("t", "o"), F.lit(-1)).alias("t"), F.when(F.col("t").isNotNull(), F.greatest("t", "o")).otherwise(-1).alias("o"), "fp")
    )
    ordered = split.repartition("b", "x", "t", "o").sortWithinPartitions("b", "x", "t", "o")
    return ordered.mapInArrow(lambda it: _runs(it, radius), "u long, v long")


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, k, fp) per row, and (fp, component_id, component_size) per fingerprint, both materialised."""
    fps = materialise(fingerprints(docs, id_col, text_col, width), "fp")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(near_links(nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    top = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    return fps, materialise(rooted.join(top, "root").select("fp", "root", "component_id", "component_size"), "classes")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (hex), component_id (smallest id reachable) and component size."""
    fps, known = classes(docs, id_col, text_col, width, radius)
    return fps.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of least id, null ids last. Unrelated fingerprints come within five bits with a chance of 5e-13."""
    fps, known = classes(docs, id_col, text_col, width, radius)
    rows = fps.groupBy("id", "k", "fp").agg(F.count("*").alias("n")).join(known.select("fp", "root"), "fp")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k", "n")).alias("f")).select(F.col("f.id").alias("_i"), F.col("f.k").alias("_k"), F.col("f.n").alias("_n"))
    stay = packed(docs, id_col, text_col).join(materialise(first, "first"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k")))
    # rows repeated in full: only these few need a grouping of their own
    once = stay.where("_n > 1").withColumn("_place", F.row_number().over(Window.partitionBy("_i", "_k").orderBy(F.lit(1)))).where("_place = 1")
    return stay.where("_n = 1").select("r.*").union(once.select("r.*"))
