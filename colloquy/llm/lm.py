"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Every word enters the model with all its subword ids, a position each, and attention runs over them. Where a word or the end comes next, the model predicts
the class of its leading id from the ids before it; the word, with whatever follows its leading id, comes from its count within the class, so
P(word | context) = P(class | context) * P(word | class). Leading ids fall into classes by the company they keep (k-means over neighbour counts), split by
frequency; ids within words share a class and have vectors of their own. ``scored`` can also stand words for by their leading ids alone.

Counts come from all training texts by a grouped aggregation, and so do the class totals and the company of ids; the attention weights
are trained by tasks over all training texts, whatever their length, each block once, and averaged by tokens after each of ROUNDS rounds. Scoring cuts a text into overlapping windows of
2 * BLOCK ids that move by BLOCK; the newer half of each window is scored, so each token is scored once, in batched masked attention. Its products are
taken block by block, so that a text's score doesn't depend on the texts beside it.

Only the HEAD most frequent words travel to the workers, a bounded table. The rest of each text's words meet
their counts in a join; none of them is frequent enough to make a hot key.

Cases: a null text is empty and has the end token alone; null ids count as the text "" for the split; repeated rows count
and score each; very long texts are learned from and scored whole, window by window; ids of equal frequency are classed in their order; extra columns are ignored; an empty table gives no rows, and one without training texts zero counts.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, flat, giving_back, materialise, raw, release

HEAD = 100_000
BLOCK, WIDTH = 16, 16
#: Groups of ids by company, frequency bands of each group, rounds of training, blocks of a step and of a stretch that one round takes.
COMPANY, BANDS, ROUNDS, STEP_BLOCKS, RUN = 8, 7, 4, 64, 16
#: Blocks scored at a time, and ids of a batch that are worked on at a time.
SCORED, SLICE = 64, 1 << 18
#: Words whose leading ids are found in one text.
LEAD_WORDS = 2_000
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def times(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``t @ w`` as one product of two matrices, not one for each block."""
    return (t.reshape(-1, t.shape[-1]) @ w).reshape(*t.shape[:-1], w.shape[1])


def exps(s: np.ndarray, alike: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(s - shift), its sums over the last axis, and the shift: a row's maximum, but only where plain numbers would leave the range of floats.

    With ``alike`` equal rows, or equal blocks of rows, have equal sums wherever they stand.
    """
    ones, shift = np.ones((s.shape[-1], 1), s.dtype), 0.0
    sums = lambda t: times(t, ones) if not alike else t @ ones if t.ndim > 2 else t.sum(-1, keepdims=True)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.exp(s)
        total = sums(out)
    if total.size and not (total.min() > 1e-20 and total.max() < 1e20):
        shift = np.where((total > 1e-20) & (total < 1e20), np.zeros((), s.dtype), s.max(-1, keepdims=True))
        out = np.exp(s - shift)
        total = sums(out)
    return out, total, shift


class Attention:
    """One head over class and id embeddings with a bias per distance; ids: 0..n_ids - 1, the last being the end (and start)."""

    def __init__(self, classes: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, d = int(classes.max()) + 1, WIDTH
        new = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.classes, self.n = classes, n
        self.p = {"ec": rng.standard_normal((n, d)).astype(np.float32) * 0.3, "ei": np.zeros((len(classes), d), np.float32), "q": new(d, d), "k": new(d, d), "v": new(d, d), "o": new(d, d), "u": new(d, n), "c": np.zeros(n, np.float32), "b": np.zeros(2 * BLOCK, np.float32)}
        i, j = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
        self.distance = np.clip(i + BLOCK - j, 0, 2 * BLOCK - 1)
        self.seen = j <= i + BLOCK  # no look ahead

    def forward(self, x: np.ndarray, joined: np.ndarray, alike: bool = False) -> tuple:
        """x: (blocks, BLOCK) input ids; joined: whether a block goes on from the one before. Gives h and what backward needs.

        One product of all blocks rounds a row by its place among them; with ``alike`` products are taken block by block, and equal blocks give equal rows.
        """
        p, scale, times_ = self.p, np.float32(1 / math.sqrt(WIDTH)), np.matmul if alike else times
        e = p["ec"].take(self.classes.take(x), 0)
        e += p["ei"].take(x, 0)
        q, k, v = np.split(times_(e, np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1)), 3, axis=-1)

        def with_before(t: np.ndarray) -> np.ndarray:
            out = np.empty((len(t), 2 * BLOCK, WIDTH), t.dtype)
            out[:1, :BLOCK], out[1:, :BLOCK], out[:, BLOCK:] = 0, t[:-1], t
            return out

        kk, vv = with_before(k), with_before(v)
        s = q @ kk.transpose(0, 2, 1)
        s += np.where(self.seen, p["b"][self.distance], np.float32(-1e9))
        s[~joined, :, :BLOCK] = -1e9
        a, total, _ = exps(s, alike)
        a *= 1 / total
        o = a @ vv
        return e + times_(o, p["o"]), (e, q, kk, vv, a, o)

    def log_class(self, x: np.ndarray, joined: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of the class of each id in y, 0 where ``counts`` doesn't hold."""
        counts = np.ones(y.shape, bool) if counts is None else counts
        out = np.zeros(y.shape, self.p["u"].dtype)
        for k in range(0, len(x), SCORED):  # the block before comes along as context
            lo, own = max(0, k - 1), slice(k, k + SCORED)
            on = joined[lo : k + SCORED].copy()
            on[:1] = False
            h, _ = self.forward(x[lo : k + SCORED], on, alike=True)
            z = (h[k - lo :] @ self.p["u"])[counts[own]]
            z += self.p["c"]
            picked = z[np.arange(len(z)), self.classes.take(y[own][counts[own]])]
            _, total, shift = exps(z, alike=True)
            out[own][counts[own]] = (picked[:, None] - shift - np.log(total))[:, 0]
        return out

    def gradients(self, x: np.ndarray, joined: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean loss over positions where ``counts`` holds, its gradients, and the ids that the rows of that of ``ei`` belong to."""
        p, scale = self.p, np.float32(1 / math.sqrt(WIDTH))
        h, (e, q, kk, vv, a, o) = self.forward(x, joined)
        two = lambda t: t.reshape(-1, t.shape[-1])
        told = np.flatnonzero(counts.ravel())  # the others are context and predict nothing
        h, m = two(h).take(told, 0), h.dtype.type(1 / max(1, len(told)))
        z = h @ p["u"]
        z += p["c"]
        right = np.arange(len(z)) * self.n + self.classes.take(y.ravel().take(told))
        picked = z.reshape(-1)[right]
        z, total, shift = exps(z)
        loss = float(-(picked[:, None] - shift - np.log(total)).sum() * m)
        z *= m / total
        z.reshape(-1)[right] -= m
        g = {"u": (z.T @ h).T, "c": np.ones(len(z), z.dtype) @ z}
        dh = np.zeros((x.size, WIDTH), z.dtype)
        dh[told] = z @ p["u"].T
        dh = dh.reshape(e.shape)
        g["o"] = two(o).T @ two(dh)
        do = times(dh, p["o"].T)
        da = do @ vv.transpose(0, 2, 1)
        dvv = a.transpose(0, 2, 1) @ do
        da -= np.einsum("bij,bij->bi", da, a)[..., None]
        ds = da
        ds *= a
        g["b"] = np.bincount(self.distance.ravel(), np.where(self.seen, ds.sum(0), 0).ravel(), 2 * BLOCK).astype(z.dtype)
        d, dkk = np.empty((*x.shape, 3 * WIDTH), ds.dtype), ds.transpose(0, 2, 1) @ q
        d[..., :WIDTH] = ds @ kk
        d[..., :WIDTH] *= scale
        for at, t in ((WIDTH, dkk), (2 * WIDTH, dvv)):  # a block's own keys and values, and those that the next block met
            d[..., at : at + WIDTH] = t[:, BLOCK:]
            d[:-1, :, at : at + WIDTH] += t[1:, :BLOCK]
        d = two(d)
        g |= dict(zip("qkv", np.split(two(e).T @ d, 3, axis=1)))
        de = two(dh) + d @ np.concatenate([p["q"], p["k"], p["v"]], axis=1).T
        order = np.argsort(x.ravel().astype(np.min_scalar_type(len(self.classes))), kind="stable")
        ids = x.ravel().take(order)
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        ids = ids[starts]
        g["ei"] = np.add.reduceat(de.take(order, 0), starts, axis=0)
        g["ec"] = (np.arange(self.n)[:, None] == self.classes[ids]).astype(de.dtype) @ g["ei"]
        return loss, g, ids

    def train(self, x: np.ndarray, joined: np.ndarray, y: np.ndarray, counts: np.ndarray, rate: float = 0.01) -> None:
        """One pass: Adam steps for the dense weights, and for the vectors of the ids that a step has met, steps that shrink with their past gradients."""
        if not hasattr(self, "moments"):
            self.n_steps, self.moments = 0, np.zeros((2, sum(w.size for k, w in self.p.items() if k != "ei")), np.float32)
            self.past = np.zeros(len(self.classes), np.float32)
        # the dense weights as one row of numbers, of which each is a part
        names = [k for k in self.p if k != "ei"]
        dense, (first, second) = np.concatenate([self.p[k].ravel() for k in names]), self.moments
        for k, w in zip(names, np.split(dense, np.cumsum([self.p[k].size for k in names])[:-1])):
            self.p[k] = w.reshape(self.p[k].shape)
        parts = [slice(k, k + STEP_BLOCKS) for k in range(0, len(x), STEP_BLOCKS)]
        for k in np.random.default_rng(5).permutation(len(parts)):
            on = joined[parts[k]].copy()
            on[:1] = False
            self.n_steps += 1
            _, g, ids = self.gradients(x[parts[k]], on, y[parts[k]], counts[parts[k]])
            new = np.concatenate([g[name].ravel() for name in names])
            first += 0.1 * (new - first)
            second += 0.01 * (new * new - second)
            dense -= rate * (first / (1 - 0.9**self.n_steps)) / (np.sqrt(second / (1 - 0.99**self.n_steps)) + 1e-6)
            self.past[ids] += (g["ei"] ** 2).mean(1)
            self.p["ei"][ids] -= 5 * rate * g["ei"] / (np.sqrt(self.past[ids])[:, None] + 1e-6)


def blocks(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, whether a block goes on, targets, which positions count, and the text of each block, for id sequences that each get an end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(n)))[:-1] * BLOCK
    y = np.full(int(n.sum()) * BLOCK, end, np.int64)
    x = y.copy()
    counts = np.zeros(len(y), bool)
    for at, t in zip(first.tolist(), texts):
        y[at : at + len(t)] = t
        x[at + 1 : at + 1 + len(t)] = t
        counts[at : at + len(t) + 1] = True
    joined = np.ones(int(n.sum()), bool)
    joined[first // BLOCK] = False
    shape = lambda t: t.reshape(-1, BLOCK)
    return shape(x), joined, shape(y), shape(counts), np.repeat(np.arange(len(texts)), n)


def marks_of(freq: np.ndarray) -> np.ndarray:
    """Frequent ids, as company."""
    return np.argsort(-freq, kind="stable")[: min(96, np.count_nonzero(freq))]


def company(texts: list[np.ndarray], end: int, marks: np.ndarray, table: np.ndarray) -> None:
    """Add to the flat ``table`` how often each id has each mark within four places; texts don't meet."""
    gap = np.full(4, -1, np.int64)
    ids = np.concatenate([part for t in texts for part in (t, [end], gap)]).astype(np.int64) if texts else gap
    place = np.full(end + 2, -1)
    place[marks] = np.arange(len(marks))
    near = place[ids]
    cells = []
    for g in (1, 2, 3, 4):
        for a, b in ((ids[:-g], near[g:]), (ids[g:], near[:-g])):
            ok = (a >= 0) & (b >= 0)
            cells.append(a[ok] * len(marks) + b[ok])
    np.add.at(table, np.concatenate(cells), 1)


def id_classes(all_freq: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """A class for each id: groups of ids that keep the same company, in bands of frequency; ids not seen share one, the end has its own."""
    ids = np.flatnonzero(all_freq)
    if not len(ids):
        ids = np.array([end])
    freq = np.maximum(1, all_freq[ids])
    table = counts.reshape(end + 1, -1)[ids].astype(np.float64)
    table = np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))
    # centres: farthest-first from the most frequent id, over ids frequent enough to have a clear company
    solid = np.argsort(-freq, kind="stable")[: max(1, min(400, len(ids)))]
    centres = [table[solid[0]]]
    while len(centres) < COMPANY:
        gaps = np.min([((table[solid] - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(table[solid[int(gaps.argmax())]])
    centres = np.array(centres)
    for _ in range(15):
        group = ((table**2).sum(1)[:, None] - 2 * table @ centres.T + (centres**2).sum(1)).argmin(1)
        for g in range(COMPANY):
            if (w := freq * (group == g)).any():
                centres[g] = (table * w[:, None]).sum(0) / w.sum()
    out = np.full(end + 1, COMPANY * BANDS, np.int32)
    for g in range(COMPANY):
        own = np.flatnonzero(group == g)
        own = own[np.argsort(-freq[own], kind="stable")]
        mass = np.cumsum(freq[own])
        out[ids[own]] = g * BANDS + np.minimum(BANDS - 1, (mass - freq[own]) * BANDS // max(1, mass[-1] if len(mass) else 1))
    out[end] = COMPANY * BANDS + 1
    return out


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] numbers), first[1], first[1] + 1, ..."""
    out = np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    out += np.arange(len(out))
    return out


def pieces(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of all words in a row, and how many each word has. Words without white space are encoded many as one text: no subword crosses the blank before the next."""
    enc, ids, first, sizes = _encoding(path), [np.empty(0, np.int64)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    shown = ((k, w, w.decode("utf-8", "replace")) for k, w in enumerate(words) if not w.isascii())
    alone = {k for k, w, t in shown if len(t.split()) != 1 or t.split()[0] != t or "\ufffd" in t}
    joined = [k for k in range(len(words)) if k not in alone]
    n = 0
    for at in range(0, len(joined), LEAD_WORDS):
        some = joined[at : at + LEAD_WORDS]
        ids.append(np.array(enc.encode_ordinary((b" " + b" ".join(words[k] for k in some)).decode()), np.int64))
        ends = np.cumsum(_lengths(path)[ids[-1]])
        begins = np.cumsum([0, *(len(words[k]) + 1 for k in some[:-1])])
        begin = np.searchsorted(ends, begins, side="right")
        assert (ends[begin - 1][begin > 0] == begins[begin > 0]).all(), "a subword crosses a blank"
        first[some], sizes[some] = n + begin, np.diff(begin, append=len(ids[-1]))
        n += len(ids[-1])
    for k in alone:
        ids.append(np.array(enc.encode_ordinary(" " + words[k].decode("utf-8", "replace")), np.int64))
        first[k], sizes[k] = n, len(ids[-1])
        n += len(ids[-1])
    return np.concatenate(ids)[runs(first, sizes)], sizes


def lead(words: list[bytes], path: str) -> np.ndarray:
    """The leading subword id of each word."""
    ids, sizes = pieces(words, path)
    return ids[np.cumsum(sizes) - sizes]


@lru_cache(maxsize=1)
def _lengths(path: str) -> np.ndarray:
    """Bytes of each subword."""
    enc = _encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.max_token_value + 1)], np.int64)


@lru_cache(maxsize=1)
def opening(path: str) -> np.ndarray:
    """Whether a subword, or the end, which comes last, opens a word: those within words hold no blank."""
    enc = _encoding(path)
    return np.array([enc.decode_single_token_bytes(i).startswith(b" ") for i in range(n_ids(path))] + [True])


def n_ids(path: str) -> int:
    return _encoding(path).max_token_value + 1


def words_of(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct lower-case words of a batch of texts, the place of every word among them, and the text of every word."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words = parts.flatten().dictionary_encode()
    data, at = flat(words.dictionary)
    data, at = data.tobytes(), at.tolist()
    distinct = [data[x:y] for x, y in zip(at, at[1:])]
    codes, text = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(column)), parts.value_lengths().to_numpy())
    # blanks at an end of a text leave an empty word
    if b"" in distinct:
        none = distinct.index(b"")
        distinct[none] = distinct[-1]
        distinct.pop()
        keep = codes != none
        codes, text = codes[keep], text[keep]
        codes[codes == len(distinct)] = none
    return distinct, codes, text


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c) over the training texts; the empty word is the end token. Tasks hand on what they have counted in each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, codes, _ = words_of(b.column(0))
            shown = pa.array([w.decode("utf-8", "replace") for w in [b"", *words]], pa.string())
            yield pa.RecordBatch.from_arrays([shown, pa.array(np.append(b.num_rows, np.bincount(codes, minlength=len(words))), pa.int64())], ["word", "c"])

    train = docs.where(~held_out(id_col)).select(F.col(text_col).cast("string").alias("t"))
    return train.mapInArrow(giving_back(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_sums(counts: DataFrame, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Per subword id the occurrences and the number of the training words that it leads; bounded by the vocabulary."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
        for b in batches:
            at = lead(raw(b.column(0)), path)
            np.add.at(c, at, b.column(1).to_numpy())
            np.add.at(k, at, 1)
        at = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at]), pa.array(k[at])], ["at", "n", "k"])

    got = counts.where("word <> ''").mapInArrow(sums, "at long, n long, k long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow()
    c, k = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
    c[got["at"].to_numpy()], k[got["at"].to_numpy()] = got["n"].to_numpy(), got["k"].to_numpy()
    return c, k


def sequences(packed: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The ids of the texts of a batch, as many texts at a time as begin within some SLICE ids, each time after the place of the first of them."""
    packed = packed.cast(pa.large_binary())
    at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 4
    data = packed.buffers()[2]
    ids = np.frombuffer(data, np.int32, int(at[-1])) if data is not None and data.size else np.empty(0, np.int32)
    part = (at[:-1] - at[:1]) // SLICE
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(packed)]):
        yield a, [ids[x:y] for x, y in zip(at[a:z].tolist(), at[a + 1 : z + 1].tolist())]


def fitted(ids: DataFrame, freq: np.ndarray, end: int, opens: np.ndarray) -> Attention:
    """Classes and weights from all training texts, ``ids.ids`` as packed numbers: company is a grouped sum; the texts' blocks fall into ROUNDS parts, and in
    each round every task trains on one part of its blocks, so that each is learned from once, and the weights are averaged by ids. Company is that of leading ids."""
    sc, marks = ids.sparkSession.sparkContext, marks_of(freq)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((end + 1) * len(marks), np.int64)
        for b in batches:
            for _, texts in sequences(b.column(0)):
                company([t[opens[t]] for t in texts], end, marks, table)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["at", "n"])

    if not freq[end]:
        return Attention(id_classes(freq, np.zeros(end + 1), end))
    beside, got = np.zeros((end + 1) * len(marks), np.int64), ids.mapInArrow(giving_back(meet), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    beside[got["at"].to_numpy()] = got["n"].to_numpy()
    model = Attention(id_classes(freq, beside, end))
    names = sorted(model.p)
    shapes = {name: np.atleast_2d(w).shape for name, w in model.p.items()}
    kind, cols = "name int, at long, weight double, value binary", ["name", "at", "weight", "value"]

    def rows(name: str, weight: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(weight)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), names.index(name), np.int32)), pa.array(at), pa.array(weight[at]), pa.array([v.tobytes() for v in value[at]], pa.binary())], cols)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = {name: np.zeros(shapes[name][0]) for name in names}
        value = {name: np.zeros(shapes[name]) for name in names}
        for b in batches:
            for k, at, w, v in zip(*(c.to_pylist() for c in b.columns)):
                weight[names[k]][at] += w
                value[names[k]][at] += np.frombuffer(v, np.float64)
        for name in names:
            yield rows(name, weight[name], value[name])

    for turn in range(ROUNDS):
        sent = sc.broadcast(pickle.dumps(model))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            own, seen = pickle.loads(sent.value), np.zeros(end + 1)
            for x, joined, y, counted, _ in (blocks(texts, end) for b in batches for _, texts in sequences(b.column(0))):
                # stretches of RUN blocks in turn; the first of a stretch lacks the block before it
                mine = np.flatnonzero(np.arange(len(x)) // RUN % ROUNDS == turn)
                if len(mine):
                    joined = joined[mine] & np.concatenate(([False], mine[1:] == mine[:-1] + 1))
                    x, y, counted = x[mine], y[mine], counted[mine]
                    own.train(x, joined, y, counted & opens[y])
                    seen += np.bincount(x[counted], minlength=end + 1)
            for name in names:
                # an id's own vector counts by the times it was seen
                w = seen if name == "ei" else np.full(shapes[name][0], seen.sum())
                yield rows(name, w, np.atleast_2d(own.p[name]).astype(np.float64) * w[:, None])

        got = ids.mapInArrow(giving_back(learn), kind).repartition("at").mapInArrow(merge, kind).toArrow()
        for name in names:
            now = np.atleast_2d(model.p[name]).astype(np.float64)
            part = got.filter(pc.equal(got["name"], names.index(name)))
            if part.num_rows:
                value = np.frombuffer(b"".join(part["value"].to_pylist()), np.float64).reshape(part.num_rows, -1)
                now[part["at"].to_numpy()] = value / part["weight"].to_numpy()[:, None]
            model.p[name] = now.astype(np.float32).reshape(model.p[name].shape)
        sent.destroy()
    return model


def encoded(texts: DataFrame, known: list, path: str, whole: bool = False) -> DataFrame:
    """(id, held_out, n_words, n_head, head, tail, ids) per row: sums over the words in ``known``, the counts of the others, and the packed ids, all of each word
    where ``whole`` holds and else its leading one. texts: (id, held_out, text)."""
    table = {r.word.encode(): i for i, r in enumerate(known)}
    log_c = np.log10(np.array([r.c for r in known], np.float64) + 0.5)
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps((table, log_c, *pieces(list(table), path))))
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, log_c, ids_of, sizes_of = pickle.loads(sent.value)
        first_of = np.cumsum(sizes_of) - sizes_of
        for b in batches:
            words, codes, text = words_of(b.column(2))
            n, at = b.num_rows, np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
            is_head, rest = at >= 0, np.flatnonzero(at < 0)
            log_own, first, sizes = np.zeros(len(words)), np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            log_own[is_head], first[is_head], sizes[is_head] = log_c[at[is_head]], first_of[at[is_head]], sizes_of[at[is_head]]
            others = [words[k] for k in rest.tolist()]
            more, sizes[rest] = pieces(others, path)
            first[rest] = len(ids_of) + np.cumsum(sizes[rest]) - sizes[rest]
            own = np.concatenate([ids_of, more]).astype(np.int32)
            sizes = sizes if whole else np.minimum(sizes, 1)
            # the other words of each text, with how often they stand in it
            at_rest = np.cumsum(~is_head) - 1
            known_here = is_head[codes]
            pairs, tf = np.unique(text[~known_here] * max(1, len(rest)) + at_rest[codes[~known_here]], return_counts=True)
            per_text = lambda x, **k: np.bincount(x, minlength=n, **k)
            ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            shown = pa.array([w.decode("utf-8", "replace") for w in others], pa.string()).take(pa.array(pairs % max(1, len(rest))))
            tails = pa.StructArray.from_arrays([shown, pa.array(tf, pa.int64())], ["word", "tf"])
            tails = pa.ListArray.from_arrays(ends(per_text(pairs // max(1, len(rest)))), tails)
            n_words = per_text(text)
            n_own = np.bincount(text, sizes[codes], n).astype(np.int64)
            ids = [own[runs(first[some], sizes[some])] for some in (codes[k : k + SLICE] for k in range(0, max(1, len(codes)), SLICE))]
            ids = pa.Array.from_buffers(pa.binary(), n, [None, ends(4 * n_own).buffers()[1], pa.py_buffer(np.concatenate(ids))])
            cols = [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(per_text(text[known_here]), pa.int64()), pa.array(per_text(text, weights=log_own[codes]), pa.float64()), tails, ids]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_words", "n_head", "head", "tail", "ids"])

    return texts.mapInArrow(giving_back(work), f"id {kind}, held_out boolean, n_words long, n_head long, head double, tail array<struct<word:string,tf:long>>, ids binary")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, head: int = HEAD, whole: bool = False) -> tuple[DataFrame, Attention]:
    """The rows of ``lm_scores`` and the model; without ``whole``, words enter the model with their leading ids alone."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = vocabulary or vocabulary_path()
    counts = materialise(word_counts(docs, id_col, text_col), "counts")
    release(spark)
    n, v = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where("word = ''").first()
    ends = ends.c if ends else 0
    end = n_ids(path)
    # the counts from which at most ``head`` words are left, by the histogram of counts; it has few rows for any corpus
    words = counts.where("word <> '' and c > 0")
    run = F.sum("k").over(Window.orderBy(F.desc("c")))
    least = words.groupBy("c").agg(F.count("*").alias("k")).withColumn("run", run).where(F.col("run") <= head).agg(F.min("c").alias("c")).first().c or 1 << 62
    known = sorted(words.where(F.col("c") >= least).collect(), key=lambda r: r.word)
    texts = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(encoded(texts, known, path, whole).withColumn("row", F.monotonically_increasing_id()), "ids")
    del known
    freq, kinds = id_sums(counts, path, end)
    freq[end] = ends
    opens = opening(path)
    model = fitted(rows.where("not held_out").select("ids"), freq, end, opens)
    size = 0.5 + np.bincount(model.classes[:end], freq[:end] + 0.5 * kinds[:end], model.n)
    sent = spark.sparkContext.broadcast(pickle.dumps((model, np.log10(size))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_size = pickle.loads(sent.value)
        for b in batches:
            for a, texts in sequences(b.column(1)):
                x, joined, y, counted, of_text = blocks(texts, end)
                counted &= opens[y]
                part = model.log_class(x, joined, y, counted).astype(np.float64).sum(1)
                by_class = np.where(counted & (y != end), log_size[model.classes[y]], 0.0).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), pa.array(np.bincount(of_text, part / math.log(10) - by_class, len(texts)))], ["row", "context"])

    context = rows.select("row", "ids").mapInArrow(giving_back(score), "row long, context double")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    met = tail.join(words.where(F.col("c") < least), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    met = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_tail"), F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("rest"))
    said = F.col("head") + F.coalesce("rest", F.lit(0.0))
    slim = rows.select("row", F.col("id").alias("_id"), "held_out", "n_words", "n_head", "head")
    out = slim.join(context, "row").join(met, "row", "left").select(
        F.col("_id").alias(id_col), "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (said + math.log10(ends + 0.5) - (F.col("n_words") + 1) * math.log10(n + 0.5 * (v + 1))).alias("base_score"), (said + F.col("context")).alias("score"),
    )
    return out, model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    return scored(docs, id_col, text_col, vocabulary, head, whole=True)[0]
