"""Chunks of text, and a table of values worked out once a chunk.

Texts are cut where a token or word can't cross: at ASCII white space, around special strings, and where ASCII
characters of different kinds meet (the kinds are the caller's; other characters are never cut apart). The
chunks of a run of texts are found, hashed and told apart by numpy; each different chunk is looked up once,
its bytes compared with those of the remembered chunk of the same hash. Within a run, chunks of one 64-bit
hash count as equal.

A table keeps the values of at most MOST chunks or MOST_BYTES; beyond that the half that was used least
recently goes, so a growing vocabulary neither fills the memory nor keeps newer chunks out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from . import textops

#: Chunks that a table remembers, bytes of their values, and bytes of text that are hashed at a time.
MOST, MOST_BYTES, RUN = 400_000, 32 << 20, 1 << 20
#: Longer chunks are worked out each time.
LONG = 1 << 12
#: Numbers of a table that are moved at a time, as their positions take eight bytes each.
_BLOCK = 1 << 18


def _kinds(*groups: str) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte as the left and as the right one of two, 0 for those that are not cut apart."""
    left = np.zeros(256, np.uint8)
    for k, group in enumerate(groups, 1):
        left[list(group.encode())] = k
    right = left.copy()
    left[ord("'")] = 0  # what follows an apostrophe may be a contraction
    return left, right


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_SIGNS = "".join(chr(b) for b in range(33, 127) if chr(b) not in _LETTERS + _DIGITS)
#: Letters, digits and signs apart, and digits and the underscore as parts of words.
TOKENS, WORDS = _kinds(_LETTERS, _DIGITS, _SIGNS), _kinds(_LETTERS + _DIGITS + "_", _SIGNS.replace("_", ""))


def _after_wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of positions, those that follow a white space character beyond ASCII."""
    a, b, c = (np.where(at >= k, raw[at - k], 0) for k in (1, 2, 3))
    two = (b == 0xC2) & ((a == 0xA0) | (a == 0x85))
    general = (c == 0xE2) & (b == 0x80) & (((a >= 0x80) & (a <= 0x8A)) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    return two | general | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE2) & (b == 0x81) & (a == 0x9F)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


def cut(raw: np.ndarray, ends: np.ndarray, spaced: bool, special: re.Pattern[bytes] | None = None, kinds: tuple[np.ndarray, np.ndarray] = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the rows of a run: where each starts and ends, and how many precede each row (rows + 1 numbers).

    spaced: a chunk holds the white space before it, and what stands at a row's end is one of its own;
    otherwise white space is left out. Matches of special are chunks by themselves."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    white = textops.SPACE[raw]
    left, right = kinds[0][raw[:-1]], kinds[1][raw[1:]]
    bound = np.zeros(n + 1, bool)
    bound[1:n] = (left != right) & (left > 0) & (right > 0)
    bound[ends] = True
    if special is not None:
        for m in special.finditer(raw.tobytes()):
            a, z = m.span()
            if np.searchsorted(ends, a, "right") == np.searchsorted(ends, z, "left"):  # within one row
                bound[a : z + 1] = False
                bound[a] = bound[z] = True
    if spaced:
        first = white.copy()
        first[1:] &= ~white[:-1]
        after = np.flatnonzero(first[1:] & (raw[:-1] >= 0x80)) + 1
        first[after[_after_wide_space(raw, after)]] = False
        start = np.flatnonzero(first | bound[:n])
        end = np.append(start[1:], n)
    else:
        first, last = ~white, ~white
        first[1:] &= white[:-1] | bound[1:n]
        last[:-1] &= white[1:] | bound[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, ends)


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of stretches that follow each other: start, start + 1, ... of each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Ragged:
    """Rows of numbers of any length."""

    def __init__(self, dtype: type | str):
        self.flat, self.start, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.rows = self.used = 0

    @property
    def nbytes(self) -> int:
        return self.used * self.flat.itemsize

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(flat))
        self.start, self.size = _room(self.start, self.rows + len(size)), _room(self.size, self.rows + len(size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.rows : self.rows + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.rows : self.rows + len(size)] = size
        self.rows, self.used = self.rows + len(size), self.used + len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows, one after the other, and how many each has."""
        size = self.size[rows]
        return self.flat[places(self.start[rows], size)], size

    def keep(self, rows: np.ndarray) -> None:
        """Only these rows, in ascending order: they are moved to the front within the table, some at a time."""
        start, size = self.start[rows], self.size[rows]
        end = np.cumsum(size)
        low = self.used = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(end, self.used + _BLOCK, "right")))
            self.flat[self.used : end[high - 1]] = self.flat[places(start[low:high], size[low:high])]
            low, self.used = high, int(end[high - 1])
        self.start[: len(rows)], self.size[: len(rows)], self.rows = end - size, size, len(rows)


class Matrix:
    """Rows of a fixed number of numbers."""

    def __init__(self, width: int):
        self.table, self.rows = np.zeros((1 << 12, width), np.float32), 0

    @property
    def nbytes(self) -> int:
        return self.rows * self.table.shape[1] * 4

    def add(self, values: np.ndarray) -> None:
        self.table = _room(self.table, self.rows + len(values))
        self.table[self.rows : self.rows + len(values)] = values
        self.rows += len(values)

    def keep(self, rows: np.ndarray) -> None:
        values = self.table[rows]
        self.__init__(self.table.shape[1])
        self.add(values)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros((max(n, len(a) * 3 // 2), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class ChunkTable:
    """Values of chunks. values gets the different new chunks as text and gives what the store's add takes, a row each."""

    def __init__(self, values: Callable[[list[str]], tuple], store: Ragged | Matrix, most: int = MOST, most_bytes: int = MOST_BYTES):
        self.values, self.store, self.most, self.most_bytes = values, store, most, most_bytes
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of the remembered chunks in order, and their rows
        self.text = Ragged(np.uint8)
        self.keys, self.last = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)
        self.turn = 0

    def _trim(self) -> None:
        n = self.store.rows
        if n <= self.most and self.store.nbytes + self.text.nbytes <= self.most_bytes:
            return
        half = n // 2
        keep = np.flatnonzero(self.last[:n] > np.partition(self.last[:n], half)[half])
        keep = keep[self.last[keep] > 0]
        self.store.keep(keep)
        self.text.keep(keep)
        self.keys[: len(keep)], self.last[: len(keep)] = self.keys[keep], self.last[keep]
        self.at = np.argsort(self.keys[: len(keep)]).astype(np.int32)
        self.known = self.keys[self.at]

    def _add(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, turn: int) -> np.ndarray:
        """New rows; turn 0: not to be remembered."""
        data, row = raw.tobytes(), self.store.rows
        chunks = [data[a:z].decode("utf-8", "surrogatepass") for a, z in zip(start.tolist(), end.tolist(), strict=True)]
        self.store.add(*self.values(chunks))
        size = end - start if turn else np.zeros(len(start), np.int64)
        self.text.add(raw[places(start, size)], size)
        self.keys, self.last = _room(self.keys, self.store.rows), _room(self.last, self.store.rows)
        self.keys[row : self.store.rows], self.last[row : self.store.rows] = keys, turn
        return np.arange(row, self.store.rows)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of remembered chunks by their hashes, -1 for those that are new."""
        if not len(self.known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.at[at], -1).astype(np.int64)

    def rows(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The store's row of each chunk; they stay what they are until the next call."""
        self._trim()
        self.turn += 1
        out = np.empty(len(start), np.int64)
        size = end - start
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._add(raw[start[i] : end[i]], np.zeros(1, np.int64), size[i : i + 1], np.zeros(1, np.uint64), 0)[0]
        short = np.flatnonzero(size <= LONG)
        low = 0
        while low < len(short):
            high = max(low + 1, int(np.searchsorted(end[short], start[short[low]] + RUN, "right")))
            part = short[low:high]
            first = int(start[part[0]])
            out[part] = self._short(raw[first : int(end[part[-1]])], start[part] - first, end[part] - first)
            low = high
        return out

    def _short(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = textops.span_hashes(textops.prefix_sums(raw), start, end)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        start, end = start[first], end[first]
        at = self._find(keys)
        held = np.flatnonzero(at >= 0)
        size = (end - start)[held]
        same = size == self.text.size[at[held]]
        mine, theirs = held[same], at[held[same]]
        wrong = raw[places(start[mine], size[same])] != self.text.take(theirs)[0]
        bad = np.concatenate((held[~same], mine[np.unique(np.repeat(np.arange(len(mine)), size[same])[wrong])]))
        if len(bad):  # another chunk has the hash: worked out anew, not remembered
            at[bad] = self._add(raw, start[bad], end[bad], keys[bad], 0)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._add(raw, start[new], end[new], keys[new], self.turn)
            place = np.searchsorted(self.known, keys[new])
            self.known, self.at = np.insert(self.known, place, keys[new]), np.insert(self.at, place, at[new])
        self.last[at[self.last[at] > 0]] = self.turn
        return at[which]


def row_sums(table: ChunkTable, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of a matrix's values over the chunks of each row of a run."""
    start, end, at = cut(raw, ends, spaced=False, kinds=WORDS)
    rows = table.rows(raw, start, end)
    values, row = table.store.table, np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.stack([np.bincount(row, values[rows, c], len(at) - 1) for c in range(values.shape[1])], axis=1)
