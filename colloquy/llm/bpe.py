"""BPE encoding and decoding by prefix-sharing trie traversal.

Words new to a worker go into a trie, one symbol an edge, the last symbol of a word marked as a word end. For every prefix the
last token of its encoding follows from the prefixes before it: it is the vocabulary token that ends the
prefix and that may follow the last token of what is left. So a walk down the trie that carries the
last tokens along its paths encodes each shared prefix once, and a word's encoding is read back
from its end. The walk takes all nodes of a depth together; an automaton over the tokens names those that end a prefix. Whether two tokens
may be neighbours is decided by the merges at their border, and kept in a table of fixed size.
Documents look up what stands between their blanks; the table of known chunks is bounded.

The vocabulary file (a JSON of the tokenizers library: BPE with an end-of-word suffix, NFC, lower case) is a parameter,
read from the worker's own installation and never copied.

Cases: a null text is an empty text, of no token; special token strings in a text become their ids, as the library's
defaults have it; repeated rows keep one output row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, giving_back, strings

#: Chunks between blanks in each of the two tables that a worker remembers; chunks met again move on from the older one, which goes when the newer is full.
KNOWN_WORDS = 100_000
#: Words of one trie, the bytes beyond which a word walks alone, and the size of the table of judged borders, as a power of two.
TRIE_WORDS, LONG_WORD, BORDER_BITS = 20_000, 64, 20
#: Rank of a pair that never merges.
_NEVER = (1 << 30, -1)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over chunks of Latin letters, ASCII digits, marks and blanks only, for the faster engine.
LATIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^\t-\r\x20a-z0-9À-ÖØ-öø-ɏ]+")


#: Of each word the packed ids and the tokens joined by blanks: two tables of plain values, which Python's collector needn't walk.
Known = tuple[dict[str, bytes], dict[str, str]]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Symbols are characters: byte b inside a word is chr(b), at its end chr(256 + b)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        letters = {c: chr(b) for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            end = token.endswith(suffix)
            s = "".join(letters[c] for c in (token[: -len(suffix)] if end else token))
            return s[:-1] + chr(256 + ord(s[-1])) if end and s else s

        self.names = {i: t for t, i in model["vocab"].items()}
        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.symbols = {i: s for s, i in self.ids.items()}
        self.sizes = {i: len(s) for s, i in self.ids.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = model["vocab"][a], model["vocab"][b]
            self.ranks[x, y] = (rank, self.ids[self.symbols[x] + self.symbols[y]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self._automaton()
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.sound = np.full(self.n_ids, -1, np.int8)  # whether a token has a spine; -1: not looked at
        # borders judged lately, one a slot
        self.borders, self.verdicts = np.full(1 << BORDER_BITS, -1, np.int64), np.zeros(1 << BORDER_BITS, bool)
        self.forget()

    def _automaton(self) -> None:
        """Aho-Corasick states, the prefixes of tokens: edges by state * 512 + symbol, where a state falls back to, its token, and the next state
        back that has one; so the tokens that end a prefix are read off its state, longest first."""
        number, tree = {"": 0}, {}
        for p in sorted({t[:k] for t in self.ids for k in range(1, len(t) + 1)}, key=len):
            number[p] = len(number)
            tree[number[p[:-1]] * 512 + ord(p[-1])] = number[p]
        back, token, link = [0] * len(number), [-1] * len(number), [-1] * len(number)
        for p, at in number.items():
            token[at] = self.ids.get(p, -1)
            if len(p) > 1:
                f, c = back[number[p[:-1]]], ord(p[-1])
                while (to := tree.get(f * 512 + c)) is None and f:
                    f = back[f]
                back[at] = f = to or 0
                link[at] = f if token[f] >= 0 else link[f]
        keys = np.fromiter(tree, np.int64, len(tree))
        order = np.argsort(keys)
        self.edges = np.append(keys[order], 1 << 62), np.append(np.fromiter(tree.values(), np.int64, len(tree))[order], 0)
        self.back, self.token, self.link = (np.array(x, np.int64) for x in (back, token, link))
        self.n_ids = max(self.names) + 1
        self.length = np.zeros(self.n_ids, np.int64)
        self.length[list(self.sizes)] = list(self.sizes.values())

    def merge(self, symbols: str, steps: list | None = None) -> list[int]:
        """Plain BPE: the pair of least rank first, leftmost on ties. steps: gets (place, rank, left part, right part) of each merge."""
        ids = [self.ids[c] for c in symbols]
        while len(ids) > 1:
            rank, k = min((self.ranks.get(p, _NEVER)[0], k) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == _NEVER[0]:
                break
            if steps is not None:
                steps.append((k, rank, len(ids) - 2))
            ids[k : k + 2] = [self.ranks[ids[k], ids[k + 1]][1]]
        return ids

    def spine(self, token: int) -> tuple[list, list] | None:
        """The symbols that stand in turn at a token's left and right end while it is merged, each with the rank that ends it.

        None for a token that merging its symbols doesn't give.
        """
        if token in self.spines:
            return self.spines[token]
        steps: list = []
        text = self.symbols[token]
        out = None
        if self.merge(text, steps) == [token]:
            ids, left, right = [self.ids[c] for c in text], [], []
            for k, rank, last in steps:
                if k == 0:
                    left.append((ids[0], rank))
                if k == last:
                    right.append((ids[-1], rank))
                ids[k : k + 2] = [self.ranks[ids[k], ids[k + 1]][1]]
            out = ([*left, (token, _NEVER[0])], [*right, (token, _NEVER[0])])
        self.spines[token] = out
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the symbols of both gives just these two tokens: no merge across the border comes before those that use its sides up.

        Of equal pairs the left one is merged first, so a merge across must come strictly before one on its left and not after one on its right.
        """
        x, y, get = self.spine(a), self.spine(b), self.ranks.get
        if x is None or y is None:
            return False
        for p, ends in x[1]:
            for q, ends_q in y[0]:
                if (found := get((p, q))) is not None and found[0] < ends and found[0] <= ends_q:
                    return False
        return True

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` of each pair, each border judged once while it keeps its slot."""
        key = a * self.n_ids + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BORDER_BITS)).astype(np.int64)
        out, miss = self.verdicts[slot], np.flatnonzero(self.borders[slot] != key)
        if len(miss):
            new, first, at = np.unique(key[miss], return_index=True, return_inverse=True)
            said = np.fromiter(map(self.may_follow, *(x.tolist() for x in np.divmod(new, self.n_ids))), bool, len(new))
            self.borders[slot[miss[first]]] = new
            # of borders that share a slot the one that stays counts
            stays = self.borders[slot[miss[first]]] == new
            self.verdicts[slot[miss[first[stays]]]] = said[stays]
            out[miss] = said[at]
        return out

    def has_spine(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.sound[tokens] < 0]).tolist():
            self.sound[t] = self.spine(t) is not None
        return self.sound[tokens] == 1

    def go(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state that each symbol leads to."""
        keys, to = self.edges
        out, todo, states = np.zeros(len(states), np.int64), np.arange(len(states)), states.copy()
        while len(todo):
            key = states * 512 + symbols[todo]
            at = np.searchsorted(keys, key)
            hit = keys[at] == key
            out[todo[hit]] = to[at[hit]]
            on = ~hit & (states > 0)
            todo, states = todo[on], self.back[states[on]]
        return out

    def last_tokens(self, states: np.ndarray, depth: int, rows: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """The last token of the encoding of each prefix of ``depth`` symbols, the longest that may stand there; lasts[row, d]: that of the row's first d + 1 symbols."""
        out, todo = np.empty(len(states), np.int64), np.arange(len(states))
        at = np.where(self.token[states] >= 0, states, self.link[states])
        while len(todo):
            if (at < 0).any():
                raise ValueError("no token ends a prefix")
            t = self.token[at]
            k = self.length[t]
            fits, part = np.empty(len(t), bool), k < depth
            fits[~part] = self.has_spine(t[~part])
            fits[part] = self.follows(lasts[rows[todo[part]], depth - 1 - k[part]], t[part])
            out[todo[fits]] = t[fits]
            todo, at = todo[~fits], self.link[at[~fits]]
        return out

    def learn(self, words: list[str]) -> Known:
        """Encode distinct words together.

        Sorted words are a trie: at each depth a run of rows with the same symbols so far is one node. The walk goes down it depth by depth, all nodes of one at once.
        """
        out: Known = {}, {}
        words = sorted(words)  # by code points, which is the order of the bytes
        short = [w for w in words if len(w) <= LONG_WORD and (w.isascii() or len(w.encode()) <= LONG_WORD)]
        for at in range(0, len(short), TRIE_WORDS):
            self._walk(short[at : at + TRIE_WORDS], out)
        if len(short) < len(words):
            for w in words:
                if len(w.encode()) > LONG_WORD:
                    self._walk_alone(w, out)
        return out

    def _walk(self, words: list[str], out: Known) -> None:
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends, n = np.cumsum(sizes), len(data)
        symbols = np.zeros((n, int(sizes.max())), np.int64)
        symbols[np.repeat(np.arange(n), sizes), np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)] = np.frombuffer(b"".join(data), np.uint8)
        symbols[np.arange(n), sizes - 1] += 256
        lasts, states, fresh = np.zeros(symbols.shape, np.int64), np.zeros(n, np.int64), np.arange(n) == 0
        for d in range(symbols.shape[1]):
            fresh[1:] |= symbols[1:, d] != symbols[:-1, d]
            on = sizes > d
            rows, nodes = np.flatnonzero(on), np.flatnonzero(on & fresh)
            now = self.go(states[nodes], symbols[nodes, d])
            of_row = np.cumsum(fresh[rows]) - 1
            lasts[rows, d] = self.last_tokens(now, d + 1, nodes, lasts)[of_row]
            states[rows] = now[of_row]
        # each word's tokens from its end
        row, place, found = np.arange(n), sizes - 1, []
        while len(row):
            t = lasts[row, place]
            found.append((row, place, t))
            place = place - self.length[t]
            row, place = row[place >= 0], place[place >= 0]
        row, place, t = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, row))
        t = t[order].astype(np.int32)
        ends = np.cumsum(np.bincount(row, minlength=n)).tolist()
        packed, names = t.tobytes(), list(map(self.names.__getitem__, t.tolist()))
        a = 0
        for w, b in zip(words, ends):
            out[0][w], out[1][w] = packed[4 * a : 4 * b], " ".join(names[a:b])
            a = b

    def _walk_alone(self, word: str, out: Known) -> None:
        """A long word: one path, symbol by symbol."""
        data = word.encode()
        keys, to = self.edges
        lasts, state = [], 0
        for d, c in enumerate(data):
            key = c + 256 * (d == len(data) - 1)
            while keys[at := keys.searchsorted(state * 512 + key)] != state * 512 + key and state:
                state = int(self.back[state])
            state = int(to[at]) if keys[at] == state * 512 + key else 0
            at = state if self.token[state] >= 0 else int(self.link[state])
            while at >= 0:
                t = int(self.token[at])
                if (k := self.sizes[t]) > d and self.spine(t) is not None or k <= d and self.follow(lasts[d - k], t):
                    break
                at = int(self.link[at])
            else:
                raise ValueError("no token ends a prefix")
            lasts.append(t)
        ids, at = [], len(lasts) - 1
        while at >= 0:
            ids.append(lasts[at])
            at -= self.sizes[lasts[at]]
        ids.reverse()
        out[0][word], out[1][word] = np.array(ids, np.int32).tobytes(), " ".join(map(self.names.__getitem__, ids))

    def follow(self, a: int, b: int) -> bool:
        """``may_follow`` by the same slots."""
        key = a * self.n_ids + b
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - BORDER_BITS
        if self.borders[slot] != key:
            self.verdicts[slot], self.borders[slot] = self.may_follow(a, b), key
        return bool(self.verdicts[slot])

    def chunks(self, text: str) -> list[str]:
        """What stands between blanks, lower case; no piece crosses a blank."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower case of each character by itself: no final form of sigma
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # these four are blanks to Python and not to the pattern
        return self.pieces.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text the ids, packed as 32-bit numbers, and the decoded text."""
        if len(self.known[0]) > KNOWN_WORDS:
            self.known, self.before = ({}, {}), self.known
        split = []
        for t in texts:
            parts = self.splitter.split(t) if self.splitter and any(s in t for s in self.special) else [t]
            split.append([self.chunks(p) if k % 2 == 0 else p for k, p in enumerate(parts)])
        new = set().union(*(p for parts in split for p in parts if isinstance(p, list))).difference(self.known[0])
        ids, shown = self.known
        if new and self.before[0]:
            again = new & self.before[0].keys()
            ids.update((c, self.before[0][c]) for c in again)
            shown.update((c, self.before[1][c]) for c in again)
            new -= again
        if new:
            letters = {c for c in new if c.isascii() and c.isalpha()}  # a word each
            cut = {c: LATIN_PIECES.findall(c) if LATIN.fullmatch(c) else self.pieces.findall(c) for c in new - letters}
            of, as_text = self.learn(list(letters.union(*cut.values())))
            ids.update((c, of[c]) for c in letters)
            shown.update((c, as_text[c]) for c in letters)
            for c, words in cut.items():
                ids[c], shown[c] = b"".join(map(of.__getitem__, words)), " ".join(map(as_text.__getitem__, words))
        out = []
        for parts in split:
            packed, said = [], []
            for p in parts:
                if not isinstance(p, list):
                    packed.append(np.int32(self.special[p]).tobytes())
                    said.append(p)
                elif p:
                    packed.append(b"".join(map(ids.__getitem__, p)))
                    said.append(" ".join(map(shown.__getitem__, p)))
            out.append((b"".join(packed), " ".join(said)))
        return out

    def forget(self) -> None:
        """Give the tables back; a worker process outlives its task and would hold them through later stages."""
        self.known: Known = ({}, {})
        self.before: Known = ({}, {})

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0][0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by blanks; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string), one row per row of ``docs``. vocabulary: a file on every worker; by default the installed one."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or vocabulary_path())
        for b in batches:
            texts = strings(b.column(1))
            for at in range(0, len(texts), 512):
                got = enc.encode_batch(texts[at : at + 512])
                ends = np.cumsum([0, *(len(i) // 4 for i, _ in got)], dtype=np.int32)
                flat = np.frombuffer(b"".join([i for i, _ in got]), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), ids, pa.array([s for _, s in got], pa.string())], ["id", "ids", "decoded"])
        enc.forget()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(giving_back(work), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
