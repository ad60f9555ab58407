"""Suffix-array dedup: bytes of a text that a 50-byte string of an earlier text covers are removed, the first copy stays.

Every 50-byte window has a minimizer, the 16-byte gram of least hash in it, so equal windows have equal minimizers wherever they stand. Consecutive
windows of one minimizer form a run. Three passes follow:

1. Per batch of texts, each distinct minimizer goes to a bucket once, however many of the batch's texts have it; buckets tell
   which minimizers stand in more than one text, and which have many different runs.
2. Only runs of such minimizers travel, each distinct run of a batch once, under its earliest text; later equal runs of
   the batch are covered at once. A bucket sorts the windows of its runs (the suffix array, cut off at 50 bytes), takes the common prefix of
   each suffix with the one before, and from these the longest previous factor of each: the longer of the prefixes that it shares with the nearest
   suffixes before and after it in order that belong to a smaller text. It reports the windows where the factor reaches 50.
3. Reported windows come back to their texts, which are cut.

Entries travel as packed arrays. There are as many buckets as the bytes of all texts ask for, so a bucket's share doesn't grow with the input. A minimizer
or run that stands everywhere sends one entry a batch. A minimizer of over HOT different runs is split: its windows
travel one by one, dealt by their first 16 bytes, so that windows of one bucket still hold all that share so long a prefix.
Batches of the second pass follow a sort-merge join, so that a task that runs again cuts them alike.

Cases: a null text is empty; a null id is later than any other and earlier than none; rows of equal id don't cover
each other; repeated rows keep a row each; ids of any orderable type; a very long text is one row of a batch and cut whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, flat, giving_back, materialise, release, row_key

LENGTH, GRAM = 50, 16
_SPAN = LENGTH - GRAM + 1  # grams in a window
_PLACE = 26  # low bits of a packed gram that hold its place
_LAST = (1 << 63) - 1
#: Windows that a bucket sorts at once, and bytes of all texts for each bucket.
SORTED, BUCKET_BYTES = 100_000, 12 << 20
#: Different runs of a minimizer from which its windows are dealt one by one, and minimizers that may be split; more of them raise the former.
HOT, SPLIT = 10_000, 100_000


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, first window, windows, text) of the runs of all texts; offsets bound the texts in data."""
    n = len(data)
    out: list[tuple] = []
    valid = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        valid[a : max(a, b - LENGTH + 1)] = True
    step = 1 << (_PLACE - 1)
    for lo in range(0, n, step):
        part = data[lo : lo + step + LENGTH - 1]
        if len(part) < LENGTH:
            break
        word = np.ndarray((len(part) - 7,), "<u8", np.ascontiguousarray(part), strides=(1,))
        n_grams = len(part) - GRAM + 1
        h = np.zeros(n_grams, np.uint64)
        for at in range(0, GRAM, 8):
            h += word[at : at + n_grams]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h = (h & np.uint64((1 << 64) - (1 << _PLACE))) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        reach = 1
        while 2 * reach <= _SPAN:
            h = np.minimum(h[:-reach], h[reach:])
            reach *= 2
        if reach < _SPAN:
            h = np.minimum(h[: len(h) - (_SPAN - reach)], h[_SPAN - reach :])
        at = np.flatnonzero(valid[lo : lo + min(step, len(h))])
        if not len(at):
            continue
        best = h[at]
        start = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1))))
        out.append((best[start] >> np.uint64(_PLACE), at[start] + lo, np.diff(np.append(start, len(at)))))
    if not out:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    hashes, first, counts = (np.concatenate(c) for c in zip(*out))
    return hashes, first, counts, np.searchsorted(offsets, first, "right") - 1


def previous_factors(common: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order.

    common: bytes that a suffix shares with the one before it (0 for the first); value: the order of its text. The nearest suffix before that
    is of smaller value is found by jumps, all suffixes at once: what a place points at has only larger or equal values
    up to it, so where that place isn't smaller itself its own pointer may be followed. The least common prefix on the way is what both share. The
    same from the other end gives the next smaller value.
    """

    def nearest(common: np.ndarray, value: np.ndarray) -> np.ndarray:
        n = len(value)
        low = np.concatenate((value[:1], value))  # place 0 ends every way
        to, shared = np.arange(n + 1) - 1, np.concatenate(([0], common))
        to[0] = 0
        open_ = np.flatnonzero((to > 0) & (low[to] >= low))
        while len(open_):
            at = to[open_]
            shared[open_] = np.minimum(shared[open_], shared[at])
            to[open_] = to[at]
            open_ = open_[(to[open_] > 0) & (low[to[open_]] >= low[open_])]
        shared[to == 0] = 0
        return shared[1:]

    if not len(value):
        return np.empty(0, np.int64)
    after = np.concatenate((common[1:], [0]))
    return np.maximum(nearest(common, value), nearest(after[::-1], value[::-1])[::-1])


def window_factors(text: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The longest previous factor, 50 at most, of the windows of ``text`` from each of ``starts`` among those of smaller ``order``."""
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts]
    suffixes = np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel()
    by_order = np.argsort(order, kind="stable")
    sa = by_order[np.argsort(suffixes[by_order], kind="stable")]
    ordered = suffixes[sa].view(np.uint8).reshape(-1, LENGTH)
    del windows, suffixes
    differs = ordered[1:] != ordered[:-1]
    common = np.concatenate(([0], np.where(differs.any(1), differs.argmax(1), LENGTH)))[: len(sa)]
    out = np.empty(len(sa), np.int64)
    out[sa] = previous_factors(common, order[sa])
    return out


# --- packed exchange: rows (bucket, uid, kind, data); kind 0 holds a batch's texts, 1 replies, 2 entries for the bucket, 3 minimizers to split

_REPLY = ["id", "k", "place", "count", "split"]
_ROW = "bucket int, uid string, kind int, data binary"


def _pack(x: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, u, k, d = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(u, pa.string()), pa.array(k, pa.int32()), pa.array([_pack(x) for x in d], pa.binary())], ["bucket", "uid", "kind", "data"])


def _uid(keys: np.ndarray, ids: list, seq: int) -> str:
    """The same in every attempt of a task."""
    return f"{TaskContext.get().partitionId()}-{seq}-{xxhash.xxh64_hexdigest(keys.tobytes() + repr(ids[:1]).encode())}"


def _home(uid: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(uid) % buckets


def _in_buckets(buckets: int, which: np.ndarray, uid: str, arrays: tuple) -> list[tuple]:
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(buckets + 1))
    return [(b, uid, 2, tuple(a[order[edges[b] : edges[b + 1]]] for a in arrays)) for b in range(buckets) if edges[b] < edges[b + 1]]


def _exchange(sent: DataFrame, buckets: int, answer: Callable[[list[tuple]], Iterator[tuple[int | None, tuple]]]) -> DataFrame:
    """Entries to their buckets, replies back to the batches' texts: (id, k, place, count) arrays per text with a reply.

    answer: gets the entries of a partition, gives (index of the entry, reply) pairs; a reply is (text, place, count) arrays.
    Without an index it is (place, count) arrays for the caller, which come as a row with ``split`` set.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, entries = [], []
        for b in batches:
            for _, uid, kind, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 2:
                    uids.append(uid)
                    entries.append(_unpack(data))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([uid]), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["bucket", "uid", "kind", "data"])
        for i, reply in answer(entries):
            yield _rows([(0, "", 3, reply) if i is None else (0, uids[i], 1, reply)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, tuple] = {}
        replies: dict[str, list] = {}
        for b in batches:
            for _, uid, kind, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    texts[uid] = _unpack(data)
                elif kind == 3:
                    place, count = _unpack(data)
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([place.astype(np.int64)], pa.list_(pa.int64())), pa.array([count.astype(np.int32)], pa.list_(pa.int32())), pa.array([True])], _REPLY)
                else:
                    replies.setdefault(uid, []).append(_unpack(data))
        for uid, got in replies.items():
            ids, keys = texts[uid]
            text, place, count = (np.concatenate(c).astype(np.int64) for c in zip(*got))
            order = np.argsort(text, kind="stable")
            text, place, count = text[order], place[order], count[order]
            own, first = np.unique(text, return_index=True)
            ends = np.append(first, len(text)).astype(np.int32)
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(kind)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own.tolist()], pa.int64()), pa.array(keys[own]), lists(place, np.int64), lists(count, np.int32), pa.array([False] * len(own))], _REPLY)

    back = sent.repartition(buckets, "bucket").mapInArrow(giving_back(reduce), _ROW)
    return back.repartition(buckets, "uid").mapInArrow(giving_back(assemble), "id long, k long, place array<long>, count array<int>, split boolean")


def _buckets(texts: DataFrame) -> int:
    """As many as the bytes of all texts ask for."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _words_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))[places]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h += p.astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def shared_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """(id, k, place, count, split): per text the minimizers that other texts have too. Rows with ``split`` hold minimizers of over HOT runs and their numbers. texts: (id, k, text)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, b in enumerate(batches):
            data, offsets = flat(b.column(2))
            h, at, count, text = runs(data, offsets)
            if not len(h):
                continue
            ids, keys = b.column(0).to_pylist(), b.column(1).to_numpy()
            uid = _uid(keys, ids, seq)
            kind = _mixed(_words_at(data, at), count)  # different runs of a minimizer mostly differ in this
            order = np.lexsort((kind, h))
            new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            first = np.flatnonzero(new)
            low, high = np.minimum.reduceat(text[order], first), np.maximum.reduceat(text[order], first)
            n_runs = np.add.reduceat((new | np.concatenate(([True], kind[order][1:] != kind[order][:-1]))).astype(np.int32), first)
            many = low != high
            group = np.cumsum(new) - 1
            here = order[many[group]]  # shared within the batch: known at once
            out = [(_home(uid, buckets), uid, 0, (ids, keys))]
            if len(here):
                out.append((_home(uid, buckets), uid, 1, (text[here].astype(np.int32), h[here].view(np.int64), np.zeros(len(here), np.uint8))))
            one = order[first]
            which = (h[one] % np.uint64(buckets)).astype(np.int64)
            out += _in_buckets(buckets, which, uid, (h[one], text[one].astype(np.int32), many, n_runs))
            yield _rows(out)

    def answer(entries: list[tuple]) -> Iterator[tuple[int | None, tuple]]:
        if not entries:
            return
        sizes = [len(e[0]) for e in entries]
        h, text, many, n_runs = (np.concatenate(c) for c in zip(*entries))
        of = np.repeat(np.arange(len(entries)), sizes)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        first = np.flatnonzero(new)
        size, all_runs = np.diff(np.append(first, len(order))), np.add.reduceat(n_runs[order].astype(np.int64), first)
        if (hot := all_runs > HOT).any():
            yield None, (h[order[first[hot]]].view(np.int64), np.minimum(all_runs[hot], (1 << 31) - 1))
        hit = np.zeros(len(order), bool)
        hit[order] = (size > 1)[np.cumsum(new) - 1]
        hit &= ~many
        for i, part in enumerate(np.split(np.flatnonzero(hit), np.searchsorted(of[hit], np.arange(1, len(entries))))):
            if len(part):
                yield i, (text[part], h[part].view(np.int64), np.zeros(len(part), np.uint8))

    return _exchange(texts.mapInArrow(giving_back(send), _ROW), buckets, answer)


def split_minimizers(shared: DataFrame) -> np.ndarray:
    """The minimizers to split, sorted; of more than SPLIT only those of the most runs."""
    each = shared.where("split").select(F.explode(F.arrays_zip("place", "count")).alias("x")).select("x.*")
    least, found = HOT, each.count()
    while found > SPLIT:
        least *= 2
        found = each.where(F.col("count") > least).count()
    got = each.where(F.col("count") > least).select("place").toArrow()["place"].to_numpy().astype(np.int64)
    return np.sort(got.view(np.uint64))


def covered_windows(texts: DataFrame, buckets: int, split: np.ndarray) -> DataFrame:
    """(id, k, place, count): runs of windows of each text that an earlier text has. texts: (id, k, text, place), the shared minimizers in ``place``."""
    sent_split = texts.sparkSession.sparkContext.broadcast(split)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent_split.value
        for seq, b in enumerate(batches):
            data, offsets = flat(b.column(2))
            h, first, count, text = runs(data, offsets)
            ids, keys = b.column(0).to_pylist(), b.column(1).to_numpy()
            uid = _uid(keys, ids, seq)
            begin = np.searchsorted(text, np.arange(len(ids) + 1))
            chosen = [np.empty(0, np.int64)]
            for i, places in enumerate(b.column(3).to_pylist()):
                # a minimizer found shared once is shared at each of its runs in the text
                chosen.append(begin[i] + np.flatnonzero(np.isin(h[begin[i] : begin[i + 1]], np.array(places, np.int64).view(np.uint64))))
            chosen = np.concatenate(chosen)
            h, first, count, text = h[chosen], first[chosen], count[chosen], text[chosen]
            if len(hot) and (single := np.isin(h, hot)).any():
                # window by window, each with its first bytes in its key
                n = count[single]
                at = np.repeat(first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = _mixed(np.repeat(h[single], n), _words_at(data, at), _words_at(data, at + 8))
                h, first = np.concatenate((h[~single], key)), np.concatenate((first[~single], at))
                count, text = np.concatenate((count[~single], np.ones(len(at), count.dtype))), np.concatenate((text[~single], np.repeat(text[single], n)))
            order = np.array([_LAST if i is None else i for i in ids], np.int64)
            raw = data.tobytes()
            spans = [raw[a:z] for a, z in zip(first.tolist(), (first + count + LENGTH - 1).tolist())]
            of = order[text]
            least: dict[bytes, int] = {}
            for s, d in zip(spans, of.tolist()):
                if least.get(s, d) >= d:
                    least[s] = d
            later = np.fromiter((least[s] < d for s, d in zip(spans, of.tolist())), bool, len(spans))
            start = first - offsets[text]
            out = [(_home(uid, buckets), uid, 0, (ids, keys))]
            if later.any():
                out.append((_home(uid, buckets), uid, 1, (text[later].astype(np.int32), start[later], count[later].astype(np.int32))))
            keep = np.flatnonzero(~later)
            which = (h[keep] % np.uint64(buckets)).astype(np.int64)
            by = keep[np.argsort(which, kind="stable")]
            edges = np.searchsorted(np.sort(which), np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                part = by[edges[k] : edges[k + 1]]
                out.append((k, uid, 2, (b"".join(spans[i] for i in part.tolist()), text[part].astype(np.int32), start[part], count[part].astype(np.uint8), h[part], of[part])))
            yield _rows(out)

    def answer(entries: list[tuple]) -> Iterator[tuple[int | None, tuple]]:
        if not entries:
            return
        data = np.frombuffer(b"".join(e[0] for e in entries), np.uint8)
        text, start, count, h, order = (np.concatenate([e[k] for e in entries]) for k in range(1, 6))
        of = np.repeat(np.arange(len(entries)), [len(e[1]) for e in entries])
        count = count.astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(count + LENGTH - 1)))[:-1]
        # whole minimizers at a time, about SORTED windows together; those of one row have nothing to meet
        by = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[by][1:] != h[by][:-1]))
        before = np.cumsum(count[by]) - count[by]
        slab = (before[np.flatnonzero(new)] // SORTED)[np.cumsum(new) - 1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in np.split(by, np.flatnonzero(np.diff(slab)) + 1):
            step = np.arange(int(count[part].sum())) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            row = np.repeat(part, count[part])
            hit = window_factors(data, begin[row] + step, order[row]) >= LENGTH
            found.append((row[hit], step[hit]))
        row, step = (np.concatenate(c) for c in zip(*found))
        if not len(row):
            return
        order_ = np.lexsort((step, row, of[row]))
        row, step = row[order_], step[order_]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1))))
        size = np.diff(np.append(first, len(row)))
        row, step = row[first], step[first]
        for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(of[row])) + 1):
            yield int(of[row[cut[0]]]), (text[row[cut]], start[row[cut]] + step[cut], size[cut].astype(np.int32))

    return _exchange(texts.mapInArrow(giving_back(send), _ROW), buckets, answer)


def _ordered(docs: DataFrame, id_col: str) -> DataFrame:
    """(_own, id): each id as a long in the order of the ids; for ids of another type, by a sort of the distinct ones."""
    ids = docs.select(F.col(id_col).alias("_own")).where("_own is not null").distinct()
    return materialise(ids.orderBy("_own").withColumn("id", F.monotonically_increasing_id()), "order")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans), one row per row of ``docs``."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("_own"), row_key(text_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):
        texts = texts.withColumn("id", F.col("_own").cast("long"))
    else:
        texts = texts.join(_ordered(docs, id_col), "_own", "left")
    slim = texts.select("id", "k", "text")
    buckets = _buckets(slim)
    named = lambda df: df.withColumnsRenamed({"id": "_i", "k": "_k"})
    match = F.col("id").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k"))
    replies = materialise(shared_runs(slim, buckets), "replies")
    split = split_minimizers(replies)
    shared = materialise(named(replies.where("not split").groupBy("id", "k").agg(F.flatten(F.collect_list("place")).alias("place"))), "shared")
    release(spark)
    covered = covered_windows(slim.join(shared, match).select("id", "k", "text", "place"), buckets, split)
    covered = materialise(named(covered.groupBy("id", "k").agg(F.flatten(F.collect_list("place")).alias("place"), F.flatten(F.collect_list("count")).alias("count"))), "covered")
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, place, count in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                sizes.append(len(text))
                if not place:
                    kept.append(text)
                    removed.append(0)
                    spans.append(0)
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, np.array(place) + np.array(count) + LENGTH - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))], ["id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = texts.join(covered, match, "left").select("_own", "text", "place", "count")
    return joined.mapInArrow(cut, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)


def cut_report(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cut.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


