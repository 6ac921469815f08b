"""BPE encoding and decoding by speculation: greedy longest match proposes, checks of adjacent pairs decide.

A token sequence is what the merges give exactly if every token is what the merges make of its own text and
every two neighbours stay apart when merged alone. So a word is first cut greedily into the longest tokens;
then all distinct neighbour pairs of a batch are checked together by numpy; only words with a pair that
fails are merged step by step. Checked pairs, words and chunks of text are remembered within bounds, beyond
which the older ones go. Decoding joins the bytes of the tokens.

The pair check runs the merges of two neighbours backwards. What touches the border is, from the last
moment to the first, a token on the right edge of the left token's merge tree and one on the left edge of
the right token's. If at any moment those two could merge before their own trees go on, the pair fails.

Defined cases: null text is empty and has no tokens; a special token's string in a text is that token, as in
the tokenizers library; texts of any length are handled whole, in runs of about 0.25 MB (a longer text is a
run of its own); of equal merges the leftmost goes first; other columns are ignored, whatever their names; rows that
share a doc_id, and repeated rows, each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textops
from .chunks import ChunkTable, Ragged, cut
from .common import prepare, texts, worker_state

#: Words that a Python worker remembers; beyond them it starts anew. Chunks of text whose ids it remembers at most.
WORDS, CHUNKS = 30_000, 100_000
#: Bytes of text encoded at a time; the numbers of a run take many times its bytes.
RUN = 1 << 18
_NEVER = np.int64(1 << 40)
#: Symbols of words that are handled many at a time.
_SHORT = 48
#: The pattern of byte-level pre-tokenizers; a fixed value of that file format.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_MARK = 0x100


def _alphabet() -> dict[str, int]:
    """The characters that stand for the bytes in such files: printable bytes for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Hashed:
    """Numbers by 64-bit keys, looked up many at a time: an open table, four places for each key."""

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        keys = keys.astype(np.uint64)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.values[at] < 0
            _, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[at[own]], self.values[at[own]] = keys[left[own]], values[left[own]]
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, at = left[rest], (at[rest] + 1) & self.last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self._SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, other: int) -> np.ndarray:
        """The numbers of keys, `other` where there is none."""
        keys = keys.astype(np.uint64, copy=False)
        at = self._place(keys)
        out = self.values[at]
        left = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        out[out < 0] = other
        at = at[left]
        while len(left):
            at = at + 1 & self.last
            v = self.values[at]
            out[left] = np.where(v < 0, other, v)
            on = (self.keys[at] != keys[left]) & (v >= 0)
            left, at = left[on], at[on]
        return out


def symbol_sums(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of words, one after the other, their sums for hashes of stretches, and where each word ends."""
    codes = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), np.uint16)
    return codes, textops.value_sums(symbol_values(codes)), np.cumsum([len(w) for w in words], dtype=np.int64)


def symbol_values(codes: np.ndarray) -> np.ndarray:
    return textops.mix(codes.astype(np.uint64) + np.uint64(1))


def _by_hash(table: dict[str, int]) -> Hashed:
    _, sums, end = symbol_sums(list(table))
    return Hashed(textops.span_hashes(sums, np.concatenate(([0], end))[:-1], end), np.fromiter(table.values(), np.int64, len(table)))


class Merges:
    """A vocabulary with merges. Symbols are characters 0-255 for bytes; where words have an end mark, their
    last byte is 0x100 higher."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}

        def symbols(token: str) -> str:
            ended = bool(self.suffix) and token.endswith(self.suffix)
            raw = [chars[c] for c in (token[: -len(self.suffix)] if ended else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + _MARK * ended) if raw else ""

        self.ids = {symbols(k): v for k, v in model["vocab"].items()}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.text: list[bytes] = [b""] * self.size
        for s, i in self.ids.items():
            self.text[i] = bytes(ord(c) & 0xFF for c in s)
        for s, i in self.special.items():
            self.text[i] = s.encode()
        self.bytes = Ragged(np.uint8)
        self.bytes.add(np.frombuffer(b"".join(self.text), np.uint8), np.fromiter(map(len, self.text), np.int64, self.size))
        n = self.size
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single symbol
        self.left, self.right = np.arange(n), np.arange(n)
        self.pairs: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (symbols(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs[x << 20 | y] = (r, z)
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        self._ranks = Hashed(keys, np.fromiter((r for r, _ in self.pairs.values()), np.int64, len(keys)))
        made = np.flatnonzero(self.rank >= 0)
        whole = np.ones(n, bool)  # tokens that the merges make of their own text
        whole[made] = self.apart(self.left[made], self.right[made], top=False)
        for z in made[np.argsort(self.rank[made])]:
            whole[z] &= whole[self.left[z]] & whole[self.right[z]]
        self.known = {s: i for s, i in self.ids.items() if whole[i]}
        self.lengths = self._lengths(lambda s: s[:3])
        self._longest, self.tokens = _by_hash({s: x[0] for s, x in self.lengths.items()}), _by_hash(self.known)
        self._made = np.zeros(len(self.pairs), np.int64)
        for r, z in self.pairs.values():
            self._made[r] = z
        self._apart: dict[int, bool] = {}

    # what follows is for those who count from the end of a word only

    @cached_property
    def lengths_at_end(self) -> dict[str, tuple[int, ...]]:
        return self._lengths(lambda s: s[-3:])

    @cached_property
    def _steps(self) -> tuple[list[int], list[int], list[int]]:
        return self.rank.tolist(), self.left.tolist(), self.right.tolist()

    @cached_property
    def longest_at_end(self) -> Hashed:
        return _by_hash({s: x[0] for s, x in self.lengths_at_end.items()})

    def _lengths(self, key: Callable[[str], str]) -> dict[str, tuple[int, ...]]:
        """Lengths of the tokens of three symbols or more by their key, the longest first, then two and one."""
        found: dict[str, set[int]] = {}
        for s in self.known:
            if len(s) > 2:
                found.setdefault(key(s), {1, 2}).add(len(s))
        return {s: tuple(sorted(x, reverse=True)) for s, x in found.items()}

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._ranks.find((x.astype(np.int64) << 20 | y).ravel(), _NEVER).reshape(x.shape)

    def apart(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """Which pairs of tokens the merges leave apart. top: whether the two tokens themselves may merge, too."""
        good = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        x_ends, y_ends = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        live, first = np.arange(len(a)), not top
        while len(live):
            m = self.merge_rank(x, y)
            # of equal ranks the left one goes first
            bad = (m < x_ends) & (m <= y_ends) & (m < _NEVER)
            if first:
                bad[:], first = False, False
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, x_ends, y_ends, rx, ry = (v[on] for v in (live, x, y, x_ends, y_ends, rx, ry))
            back = rx > ry  # the later of the two merges is undone
            x_ends, y_ends = np.where(back, rx, x_ends), np.where(back, y_ends, ry)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return good

    def stay_apart(self, a: int, b: int) -> bool:
        """The same for one pair, remembered."""
        key = a << 20 | b
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            rank, left, right = self._steps
            x, y, xe, ye, got = a, b, 1 << 40, 1 << 40, True
            while True:
                m = self.pairs.get(x << 20 | y)
                if m is not None and m[0] < xe and m[0] <= ye:
                    got = False
                    break
                rx, ry = rank[x], rank[y]
                if rx > ry:
                    xe, x = rx, right[x]
                elif ry >= 0:
                    ye, y = ry, left[y]
                else:
                    break
            self._apart[key] = got
        return got

    def greedy(self, word: str) -> list[int]:
        out, i, n, find, lengths = [], 0, len(word), self.known.get, self.lengths.get
        while i < n:
            for k in lengths(word[i : i + 3], (2, 1)):
                if (t := find(word[i : i + k])) is not None:
                    break
            else:
                raise ValueError(f"no token for symbol {word[i]!r}")
            out.append(t)
            i += k
        return out

    def exact(self, word: str) -> list[int]:
        """The merges one by one, the lowest rank first, of equal ones the leftmost; by a heap, for words of any length."""
        ids = [self.ids[c] for c in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a << 20 | b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := pairs.get(ids[i] << 20 | ids[after[i]]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (m := pairs.get(ids[h] << 20 | ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of words, all words a token further at each step: the tokens, and how many of each word."""
        _, sums, ends = symbol_sums(words)
        size = np.diff(ends, prepend=0)
        word, at = np.arange(len(words)), ends - size
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            room = ends[word] - at
            most = np.minimum(self._longest.find(textops.span_hashes(sums, at, np.minimum(at + 3, ends[word])), 2), room)
            token, step = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
            for k in range(int(most.max()), 0, -1):
                i = np.flatnonzero((token < 0) & (most >= k))
                t = self.tokens.find(textops.span_hashes(sums, at[i], at[i] + k), -1)
                token[i], step[i] = t, k
            if (token < 0).any():
                raise ValueError(f"no token for a symbol of {words[int(word[token < 0][0])]!r}")
            found.append((word, token))
            at = at + step
            on = at < ends[word]
            word, at = word[on], at[on]
        if not found:
            return np.zeros(0, np.int64), size
        owner, token = (np.concatenate(x) for x in zip(*found, strict=True))
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _merge_all(self, words: list[str]) -> list[list[int]]:
        """exact() of many words of one length at once: each round merges one pair of each word, so rows stay equally long."""
        x = np.array([[self.ids[c] for c in w] for w in words], np.int64)
        ranks, row, out = self.merge_rank(x[:, :-1], x[:, 1:]), np.arange(len(x)), [[]] * len(x)
        while True:
            j = ranks.argmin(axis=1) if x.shape[1] > 1 else np.zeros(len(x), np.int64)
            on = ranks[np.arange(len(x)), j] < _NEVER if x.shape[1] > 1 else np.zeros(len(x), bool)
            for i, ids in zip(row[~on].tolist(), x[~on].tolist(), strict=True):
                out[i] = ids
            if not on.any():
                return out
            x, ranks, j, row = x[on], ranks[on], j[on], row[on]
            n, every = len(x), np.arange(len(x))
            x[every, j] = self._made[ranks[every, j]]
            stay = np.ones(x.shape, bool)
            stay[every, j + 1] = False
            x = x[stay].reshape(n, -1)
            stay = np.ones(ranks.shape, bool)
            stay[every, j] = False
            ranks = ranks[stay].reshape(n, -1)
            for left in (j - 1, j):
                i = np.flatnonzero((left >= 0) & (left < x.shape[1] - 1))
                ranks[i, left[i]] = self.merge_rank(x[i, left[i]], x[i, left[i] + 1])

    def exact_all(self, words: list[str]) -> list[list[int]]:
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        out: list[list[int]] = [[]] * len(words)
        for size, at in by_size.items():
            got = self._merge_all([words[i] for i in at]) if 1 < size <= _SHORT else [self.exact(words[i]) for i in at]
            for i, ids in zip(at, got, strict=True):
                out[i] = ids
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: greedy proposals, one check of all pairs, merges for the words that fail."""
        short = [len(w) <= _SHORT for w in words]
        flat, size = self._propose([w for w, s in zip(words, short, strict=True) if s])
        flat, at = flat.tolist(), iter(np.cumsum(size).tolist())
        out, low = [], 0
        for w, s in zip(words, short, strict=True):
            if s:
                high = next(at)
                out.append(flat[low:high])
                low = high
            else:
                out.append(self.greedy(w))
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(size.sum()))
        if len(flat) < 2:
            return out
        word = np.repeat(np.arange(len(out)), size)
        inner = word[1:] == word[:-1]
        pair, where = np.unique((flat[:-1] << 20 | flat[1:])[inner], return_inverse=True)
        fails = ~self.apart(pair >> 20, pair & 0xFFFFF)
        wrong = np.unique(word[1:][inner][fails[where]]).tolist()
        for i, ids in zip(wrong, self.exact_all([words[i] for i in wrong]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")

    def decode_run(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids of a run of texts, and where each text ends (texts + 1 numbers, as ends)."""
        data, size = self.bytes.take(ids)
        return data, np.concatenate(([0], np.cumsum(size)))[ends]


class ByteEncoder:
    """Texts to ids for byte-level files.

    A text is cut before white space that follows other characters, where the split pattern always cuts, too, and
    around special tokens. The ids of the chunks between are remembered within the bounds of a ChunkTable."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.words: dict[str, list[int]] = {}
        self._start(self.merges.special)

    def _start(self, special: dict[str, int]) -> None:
        self.special = special
        self.specials = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self.table = ChunkTable(self._values, Ragged("<u4"), CHUNKS)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of texts without special tokens, each by the whole split pattern."""
        split = [[p] if p.isascii() and p[p[0] == " " :].isalpha() else SPLIT.findall(p) for p in pieces]
        known = self.words
        if len(known) > WORDS:
            known.clear()
        new = list({w for x in split for w in x if w not in known})
        known |= zip(new, self.merges.encode_words([w.encode("utf-8", "surrogatepass").decode("latin-1") for w in new]), strict=True)
        return [known[x[0]] if len(x) == 1 else [t for w in x for t in known[w]] for x in split]

    def _values(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.special
        plain = iter(self._encode_pieces([c for c in chunks if c not in special]))
        ids = [[special[c]] if c in special else next(plain) for c in chunks]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode_run(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts as little-endian unsigned 32-bit integers, and where each text's end."""
        start, end, at = cut(raw, ends, True, self.specials)
        ids, size = self.table.store.take(self.table.rows(raw, start, end))
        return ids, np.concatenate(([0], np.cumsum(size)))[at]

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """The same of texts, as bytes."""
        data = [t.encode("utf-8", "surrogatepass") for t in batch]
        ids, at = self.encode_run(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, data)), dtype=np.int64))))
        return [ids[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder(path: str) -> ByteEncoder:
    """The encoder of a file, once a Python worker."""
    return worker_state(("bpe", path), lambda: ByteEncoder(path))


def _round_trips(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """Runs of texts: first and last row, ids, where they end, and the UTF-8 bytes of what each text's ids decode to."""
    e = encoder(path)
    for row, last, raw, ends in textops.slices(column, RUN):
        ids, at = e.encode_run(raw, ends)
        data, end = e.merges.decode_run(ids, at)
        decoded = [data[a:z].tobytes() for a, z in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
        if not np.array_equal(data, raw):  # bytes that are no UTF-8 decode to replacement characters
            decoded = [x.decode("utf-8", "replace").encode() for x in decoded]
        yield row, last, ids, at, decoded


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))


def _tokenised(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, last, ids, at, decoded in _round_trips(b.column("text"), path):
            part = b.slice(row, last - row)
            same = [x == t.encode("utf-8", "surrogatepass") for x, t in zip(decoded, part.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), _lists(ids, at), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, round_trip); round_trip: whether the ids decode to the text."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _tokenised(it, path), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def _encoded(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, last, ids, at, decoded in _round_trips(b.column("text"), path):
            cols = {"doc_id": b.column("doc_id").slice(row, last - row), "n_tokens": pa.array(np.diff(at), pa.int64())}
            if with_ids:
                cols |= {"ids": _lists(ids, at), "decoded": pa.array([x.decode() for x in decoded], pa.string())}
            else:
                cols |= {"ids_sha256": pa.array([hashlib.sha256(ids[a:z]).hexdigest() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): the ids of each text and what they decode to."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _encoded(it, path, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): the same in short."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _encoded(it, path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
