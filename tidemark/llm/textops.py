"""Hashes of words, shingles and byte windows by numpy; every function works on one text's bytes.

A string's hash is its polynomial modulo 2**64 over random byte codes, scrambled afterwards. Sums of
prefixes give the hash of any substring, so words and windows need no Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.RandomState(20240601)
_CODES = (_rng.randint(0, 2**32, 256).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 2**32, 256).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

#: ASCII white space: the words of the shingle operators end there.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        m = max(n + 1, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverse", _BASE_INVERSE)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def value_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the weighted sum of values i..j-1."""
    n = len(values)
    _grow(n)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers[:n], out=out[1:])
    return out


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """The same of the codes of bytes."""
    return value_sums(_CODES[raw])


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), equal for equal strings wherever they stand."""
    return mix((sums[end] - sums[start]) * _inverse[start] + (end - start).astype(np.uint64))


def changed_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The same if the last value of each were higher by `more`."""
    return mix((sums[end] - sums[start]) * _inverse[start] + more * _powers[end - start - 1] + (end - start).astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of one width, by start."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * _inverse[:n] + np.uint64(width)) if n > 0 else np.zeros(0, np.uint64)


#: Codes with A-Z lowered.
_LOWERED = _CODES.copy()
_LOWERED[65:91] = _CODES[97:123]


#: Bytes of a short run, for operators whose numbers take many times the bytes of a run.
SHORT_RUN = 1 << 19


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A string column in runs of whole rows of about `most` bytes: first row, last row + 1, bytes, offsets.

    Nulls count as empty. A text longer than `most` is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, last, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def words(raw: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows of a run, and how many words precede each row (rows + 1 numbers)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    free = SPACE[raw]
    start = ~free
    start[1:] &= free[:-1] | False
    first = ends[:-1][ends[:-1] < ends[1:]]
    start[first] = ~free[first]
    stop = ~free
    stop[:-1] &= free[1:]
    stop[first[1:] - 1] = ~free[first[1:] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    n = len(raw)
    _grow(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _CODES)[raw] * _powers[:n], out=sums[1:])
    return span_hashes(sums, s, e), np.searchsorted(s, ends)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of a run, one after the other, and where each row's begin.

    A shingle is k consecutive words; a row of fewer words has its whole sequence as the only one."""
    w, at = words(raw, ends)
    rows = len(at) - 1
    count = np.diff(at)
    h = np.full(len(w), k, np.uint64)
    padded = np.concatenate((w, np.zeros(k, np.uint64)))
    for i in range(k):
        h = mix(h * _BASE + padded[i : i + len(w)])
    row = np.repeat(np.arange(rows), count)
    keep = np.arange(len(w)) <= (at[1:] - k)[row]
    for r in np.flatnonzero((count > 0) & (count < k)):
        x = np.full(1, count[r], np.uint64)
        for v in w[at[r] : at[r + 1]]:
            x = mix(x * _BASE + v)
        h[at[r]], keep[at[r]] = x[0], True
    h, row = h[keep], row[keep]
    cut = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))


def shingle_set(text: str, k: int) -> np.ndarray:
    """The same for one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), k)[0]
