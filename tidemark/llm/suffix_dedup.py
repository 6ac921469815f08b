"""Suffix-array dedup: remove every byte that a repeated window of `width` bytes covers.

Suffixes are ordered only to depth `width`, by most-significant-digit passes: each pass orders the suffixes of a
group by the next digit and drops those that are alone with theirs; the equal groups after the last pass are exactly
the repeated windows. The first passes are Spark's, the others run on bytes within a task.

* Sorting every suffix of the corpus would move width-deep suffixes for each byte, so the first digit of a window is
  its anchor: the leftmost smallest of the scrambled half-width grams in it. Equal windows have the same anchor at the
  same offset, wherever they stand. The second digit is the hash of the whole stretch of text that the windows
  around one anchor cover (a chunk). A gram that occurs once leaves: its windows are alone. Of chunks that occur
  again, every window is repeated.
* What that leaves open are grams around which different chunks stand. One copy of each such chunk is sent as text,
  and the windows of all chunks of a gram go through passes of 8 bytes each, to depth `width`: what stays together is
  equal byte by byte.
  A gram with many chunks (a footer between different neighbours) would be a group without bound, so its
  chunks don't stay together: their windows are dealt by gram and hash, 128 bits in all, instead of being sent as text.

Pass 1 aggregates in the map task first: of a chunk that occurs often there, one occurrence goes on, and the
others are already known to be repeated. So a passage that a third of the documents hold stays spread out. Of
a gram around which many different chunks stand there, only a mark goes to its bucket. Windows that are dealt
by their hashes are aggregated in the map task in the same way.

Defined cases: null text is empty; texts shorter than the width keep all bytes but can't lose any; texts of any
length are read whole, in pieces of about 128 KB that overlap by a window; matches don't cross documents; rows that
share a doc_id are documents of their own (the text's hash tells them apart; equal rows repeat each other, so both
lose their windows: no occurrence is the first); other columns are ignored by dedup() and kept by clean(), whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import materialise, partitions_of, prepare, release

#: Bytes of postings that a task holds before it hands them on.
FLUSH = 6 << 20
#: Different chunks of a gram, in what a task holds or in all, from which their windows are dealt out.
HOT = 256
#: Added to the count of a chunk that is asked for, if its windows are dealt out.
_DEALT = 1 << 20
#: Bytes of text handled at a time, whose numbers take over 100 times as much; longer texts are cut into overlapping pieces.
PIECE = 1 << 17
_INDEX_BITS = np.uint64(23)
#: A row of a table: its doc_id (the least long for null) and a hash of its text.
_ROW = np.dtype([("id", "<i8"), ("tag", "<i4")])
#: One occurrence of a chunk; a negative count: already known to be repeated; none: a mark that the gram is hot.
_POSTING = np.dtype([("gram", "<u8"), ("chunk", "<u8"), ("id", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("count", "<i2")])
#: A window that is dealt out: SINGLE, REPEATED (sent on only for others to be compared with) or KNOWN (only to be removed).
_WINDOW = np.dtype([("gram", "<u8"), ("hash", "<u8"), ("id", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("state", "<i1")])
SINGLE, REPEATED, KNOWN = range(3)
_RANGES = "id long, tag int, ranges binary, asked binary"


def anchors(sums: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows inside the rows of a run: anchor keys, first window, number of windows, row. Sorted by window."""
    gram = width // 2
    span = width - gram + 1  # grams in a window
    n = int(ends[-1]) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    g = textops.window_hashes(sums, gram)
    g = np.append(g, textops.mix((sums[-1:] - sums[len(sums) - 1 - gram : len(sums) - gram]) * textops._inverse[len(sums) - 1 - gram : len(sums) - gram] + np.uint64(gram)))
    low = (np.uint64(1) << _INDEX_BITS) - np.uint64(1)
    v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    pad = -len(v) % span
    blocks = np.concatenate((v, np.full(pad, 2**64 - 1, np.uint64))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    at = (least & low).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    inside = np.zeros(n + 1, np.int8)  # windows that stay within one row
    size = np.diff(ends)
    ok = size >= width
    np.add.at(inside, ends[:-1][ok], 1)
    np.add.at(inside, ends[1:][ok] - width + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    new[1:] |= valid[1:] & ~valid[:-1]
    begin = ends[:-1][ok]
    new[begin] = True
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    count = np.bincount(run[valid], minlength=len(start))
    first = start[count > 0]
    return g[at[first]], first, count[count > 0], np.searchsorted(ends, first, "right") - 1


def _pieces(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: bytes, ends, row numbers, each row's offset in its text. Texts beyond PIECE are cut."""
    for row, last, raw, ends in textops.slices(column, PIECE):
        if len(raw) <= 4 * PIECE:
            yield raw, ends, np.arange(row, last), np.zeros(last - row, np.int64)
        else:
            for at in range(0, len(raw), PIECE):
                part = raw[at : at + PIECE + width - 1]
                yield part, np.array([0, len(part)]), np.array([row]), np.array([at])


def _blobs(postings: np.ndarray, buckets: np.ndarray, kind: int, which: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, postings) for each bucket that occurs; which: the postings that buckets are of, if not all. Only one
    bucket's postings are copied at a time."""
    order = np.argsort(buckets, kind="stable")
    cut = [0, *(np.flatnonzero(np.diff(buckets[order])) + 1), len(buckets)]
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        if x < y:
            part = order[x:y]
            yield int(buckets[part[0]]), kind, postings[part if which is None else which[part]].tobytes()


def _batches(rows: Iterable[tuple], schema: list[tuple[str, pa.DataType]], size: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of `size` rows, which are made as the batches are asked for."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), schema, strict=True)], [n for n, _ in schema])


_SENT = [("bucket", pa.int32()), ("kind", pa.int32()), ("postings", pa.binary())]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of keys, whether it is the first of its values, and how many have the values."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = False
    for k in keys:
        head[1:] |= k[order[1:]] != k[order[:-1]]
    size = np.diff(np.append(np.flatnonzero(head), len(order)))
    first, count = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    first[order], count[order] = head, np.repeat(size, size)
    return first, count


def _chunk_postings(batches: Iterator[pa.RecordBatch], width: int, buckets: int, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Every chunk of the texts. kind 0 goes to its gram's bucket; kind 1 is known to be repeated; kind 2 has a hot gram."""
    release()
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        x = np.concatenate(held)
        held.clear()
        pa.default_memory_pool().release_unused()
        keep, size = _runs(x["chunk"])
        known = x[size > 1]
        sent = np.flatnonzero(keep)  # the postings stay where they are: a copy of all is as large as what is held
        x["count"][sent] *= np.where(size[sent] > 1, -1, 1).astype(np.int16)
        first, variants = _runs(x["gram"][sent])
        warm = variants >= hot
        dealt, marks = x[sent[warm]], x[sent[warm & first]]
        marks["count"] = 0
        sent = sent[~warm]
        if len(marks):
            x, sent = np.concatenate((x, marks)), np.concatenate((sent, np.arange(len(x), len(x) + len(marks))))
        # few rows a batch, as a row of kind 0 has a bucket's share of all that is held
        yield from _batches(_blobs(x, (x["gram"][sent] % np.uint64(buckets)).astype(np.int64), 0, sent), _SENT, 16)
        yield from _batches(chain(_blobs(known, known["id"] % buckets, 1), _blobs(dealt, dealt["id"] % buckets, 2)), _SENT)

    size = 0
    for b in batches:
        own = np.empty(b.num_rows, _ROW)
        own["id"], own["tag"] = b.column("id").to_numpy(), b.column("tag").to_numpy()
        for raw, ends, numbers, offset in _pieces(b.column("text"), width):
            sums = textops.prefix_sums(raw)
            gram, first, count, row = anchors(sums, ends, width)
            x = np.empty(len(gram), _POSTING)
            x["gram"], x["chunk"] = gram, textops.span_hashes(sums, first, first + count + (width - 1))
            x["id"], x["tag"] = own["id"][numbers[row]], own["tag"][numbers[row]]
            x["start"], x["count"] = first - ends[row] + offset[row], count
            held.append(x)
            size += x.nbytes
            if size >= FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def _joined(bucket: pa.Table, kind: int) -> np.ndarray:
    t = bucket.filter(pc.equal(bucket.column("kind"), kind))
    return np.frombuffer(b"".join(x.as_py() for x in t.column("postings")), _POSTING)


def _by_row(ranges: np.ndarray, asked: np.ndarray) -> pa.Table:
    """A row for each document row: ranges (start, end) and what is asked of it (start, count), as 32-bit integers."""
    x = np.concatenate((ranges, asked))
    kind = np.repeat([0, 1], [len(ranges), len(asked)])
    order = np.lexsort((x["start"], kind, x["tag"], x["id"]))
    x, kind = x[order], kind[order]
    new = np.ones(len(x), bool)
    new[1:] = (x["id"][1:] != x["id"][:-1]) | (x["tag"][1:] != x["tag"][:-1])
    cut = np.append(np.flatnonzero(new), len(x))
    both = np.stack((x["start"], x["end"]), axis=1).astype(np.int32)
    out: dict[str, list] = {"ranges": [], "asked": []}
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        m = i + int((kind[i:j] == 0).sum())
        out["ranges"].append(both[i:m].tobytes() if m > i else None)
        out["asked"].append(both[m:j].tobytes() if j > m else None)
    return pa.table({"id": pa.array(x["id"][new], pa.int64()), "tag": pa.array(x["tag"][new], pa.int32()), "ranges": pa.array(out["ranges"], pa.binary()), "asked": pa.array(out["asked"], pa.binary())})


_SPAN = np.dtype([("id", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("end", "<i4")])


def _spans(postings: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    x = np.empty(len(postings), _SPAN)
    x["id"], x["tag"], x["start"], x["end"] = postings["id"], postings["tag"], start, end
    return x


def _pass_1(bucket: pa.Table, width: int, hot: int = HOT) -> pa.Table:
    """Ranges of repeated chunks; one occurrence of each chunk whose gram stands in other chunks, too, is asked for."""
    release()
    x, known, dealt = (_joined(bucket, kind) for kind in range(3))
    marks = np.unique(x["gram"][x["count"] == 0])
    x = x[x["count"] != 0]
    x = x[np.lexsort((x["chunk"], x["gram"]))]
    n = len(x)
    first = np.ones(n, bool)
    first[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["chunk"][1:] != x["chunk"][:-1])
    variant = np.cumsum(first) - 1
    size = np.bincount(variant, minlength=1)
    sure = np.zeros(len(size), bool)
    np.logical_or.at(sure, variant, x["count"] < 0)
    again = (size > 1) | sure  # by variant
    head = np.flatnonzero(first)
    gram = x["gram"][head]
    mixed = np.zeros(len(head), bool)
    mixed[1:] = gram[1:] == gram[:-1]
    mixed[:-1] |= mixed[1:].copy()
    warm = (_runs(gram)[1] >= hot) | np.isin(gram, marks)  # by variant
    mixed |= warm
    covered = x[again[variant] & (x["count"] > 0)] if n else x
    chosen = x[head[mixed]] if n else x
    settled = again[mixed] if n else np.zeros(0, bool)
    count = np.abs(chosen["count"].astype(np.int64)) + _DEALT * warm[mixed]
    count = np.where(settled, -count, count)
    more = dealt["count"].astype(np.int64)
    chosen, count = np.concatenate((chosen, dealt)), np.concatenate((count, more + np.sign(more) * _DEALT))
    done = np.concatenate((covered, known))
    start = done["start"].astype(np.int64)
    return _by_row(_spans(done, start, start + np.abs(done["count"].astype(np.int64)) + width - 1), _spans(chosen, chosen["start"], count))


def _asked_chunks(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The chunks that are asked for, with their text, to the bucket of their gram; windows to be dealt out to others."""
    release()
    rows: list[tuple] = []
    windows: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        yield from _gathered(rows)
        yield from _dealt(windows, buckets)
        rows.clear()
        windows.clear()

    for b in batches:
        for own, tag, t, asked in zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), b.column("text").to_pylist(), b.column("asked"), strict=True):
            text = t.encode("utf-8", "surrogatepass")
            a = np.concatenate([np.frombuffer(v.as_buffer(), np.int32).reshape(-1, 2) for v in asked.values]).astype(np.int64)
            raw = np.frombuffer(text, np.uint8)
            apart = np.abs(a[:, 1]) > _DEALT
            if apart.any():
                windows.append(_windows_of(raw, a[apart], _anchor_of(raw, a[apart, 0], width), own, tag, width))
                size += windows[-1].nbytes
                a = a[~apart]
                if not len(a):
                    continue
            first, count = a[:, 0], np.abs(a[:, 1])
            x = np.empty(len(a), _POSTING)
            x["gram"] = _anchor_of(raw, first, width)
            x["chunk"], x["id"], x["tag"], x["start"], x["count"] = 0, own, tag, first, a[:, 1]
            for where, i, s, e in zip((x["gram"] % np.uint64(buckets)).tolist(), range(len(a)), first.tolist(), (first + count + width - 1).tolist(), strict=True):
                rows.append((where, x[i].tobytes(), text[s:e]))
                size += e - s + 64
        if size >= FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def _windows_of(raw: np.ndarray, asked: np.ndarray, gram: np.ndarray, own: int, tag: int, width: int) -> np.ndarray:
    """The windows of a text's chunks that are dealt out."""
    n = np.abs(asked[:, 1]) - _DEALT
    at = np.repeat(asked[:, 0] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    x = np.empty(len(at), _WINDOW)
    x["hash"] = textops.span_hashes(textops.prefix_sums(raw), at, at + width)
    x["gram"], x["id"], x["tag"], x["start"], x["state"] = np.repeat(gram, n), own, tag, at, np.repeat(np.where(asked[:, 1] < 0, REPEATED, SINGLE), n)
    return x


def _dealt(held: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each window one occurrence, to the bucket of its hash; all that occur again here are known to be repeated."""
    if not held:
        return
    x = np.concatenate(held)
    first, size = _runs(x["hash"], x["gram"])
    known = x[(size > 1) & (x["state"] == SINGLE)]
    known["state"] = KNOWN
    x["state"] = np.where(size > 1, REPEATED, x["state"])
    x = x[first]
    blobs = [*_blobs(x, (x["hash"] % np.uint64(buckets)).astype(np.int64), 0), *_blobs(known, known["id"] % buckets, 0)]
    yield from _batches([(buckets + k, b, None) for k, _, b in blobs], _CHUNKS)


_CHUNKS = [("bucket", pa.int32()), ("postings", pa.binary()), ("chunks", pa.binary())]


def _gathered(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    out: dict[int, tuple[list, list]] = {}
    for where, posting, text in rows:
        p = out.setdefault(where, ([], []))
        p[0].append(posting)
        p[1].append(text)
    yield from _batches([(k, b"".join(p), b"".join(t)) for k, (p, t) in out.items()], _CHUNKS)


def _anchor_of(raw: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The anchor key of the window at each start."""
    gram = width // 2
    sums = textops.prefix_sums(raw)
    at = first[:, None] + np.arange(width - gram + 1)
    g = textops.span_hashes(sums, at, at + gram)
    low = (np.uint64(1) << _INDEX_BITS) - np.uint64(1)
    pick = np.argmin((g & ~low) | np.arange(g.shape[1], dtype=np.uint64), axis=1)
    return g[np.arange(len(first)), pick]


def _pass_2(bucket: pa.Table, width: int) -> pa.Table:
    """Byte ranges that repeated windows of the sent chunks cover, some grams at a time."""
    x = np.frombuffer(b"".join(v.as_py() for v in bucket.column("postings")), _POSTING)
    text = np.frombuffer(b"".join(v.as_py() for v in bucket.column("chunks")), np.uint8)
    n = np.abs(x["count"].astype(np.int64))
    at = np.cumsum(n + width - 1) - (n + width - 1)
    order = np.argsort(x["gram"], kind="stable")
    total = np.cumsum(n[order])
    found, low = [], 0
    while low < len(order):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + (1 << 20), "right")))
        while high < len(order) and x["gram"][order[high]] == x["gram"][order[high - 1]]:
            high += 1  # chunks of a gram stay together
        found.append(_windows(x[order[low:high]], at[order[low:high]], text, width))
        low = high
    return _by_row(np.concatenate(found) if found else np.zeros(0, _SPAN), np.zeros(0, _SPAN))


def _pass_2_dealt(bucket: pa.Table, width: int) -> pa.Table:
    """Byte ranges of the windows of a bucket that are repeated."""
    x = np.frombuffer(b"".join(v.as_py() for v in bucket.column("postings")), _WINDOW)
    known, x = x[x["state"] == KNOWN], x[x["state"] != KNOWN]
    x = np.concatenate((known, x[(_runs(x["hash"], x["gram"])[1] > 1) & (x["state"] == SINGLE)]))
    x = x[np.lexsort((x["start"], x["tag"], x["id"]))]
    # windows that touch make one range
    head = np.ones(len(x), bool)
    head[1:] = (x["id"][1:] != x["id"][:-1]) | (x["tag"][1:] != x["tag"][:-1]) | (x["start"][1:] > x["start"][:-1] + width)
    last = np.append(head[1:], True)[: len(x)]
    return _by_row(_spans(x[head], x["start"][head], x["start"][last] + width), np.zeros(0, _SPAN))


def repeated(text: np.ndarray, begin: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which windows have an equal one in their group: most-significant-digit passes over 8 bytes each, to depth width."""
    step = min(8, width)
    out, live = np.zeros(len(begin), bool), np.arange(len(begin))
    # the 8 bytes from each position on, as a number; the last digit may overlap the one before
    digits = np.ndarray(max(0, len(text) - 7), ">u8", np.ascontiguousarray(text), strides=(1,)) if step == 8 else None
    for depth in range(0, width, step):
        at = begin[live] + min(depth, width - step)
        digit = digits[at].astype(np.uint64) if step == 8 else np.frombuffer(b"".join(text[a : a + step].tobytes().ljust(8, b"\0") for a in at.tolist()), ">u8").astype(np.uint64)
        order = np.lexsort((digit, group))
        d, g = digit[order], group[order]
        head = np.ones(len(order), bool)
        head[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        stay = ~(head & np.append(head[1:], True))
        live, group = live[order[stay]], (np.cumsum(head) - 1)[stay]
        if not len(live):
            break
    out[live] = True
    return out


def _windows(x: np.ndarray, at: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    n = np.abs(x["count"].astype(np.int64))
    length = n + width - 1
    here = np.cumsum(length) - length
    text = text[np.repeat(at - here, length) + np.arange(int(length.sum()))]
    owner = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(here, n)
    _, gram = np.unique(x["gram"], return_inverse=True)
    hit = repeated(text, begin, gram[owner], width)
    hit &= (x["count"] > 0)[owner]
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    turn = np.zeros(len(hit) + 1, bool)
    turn[np.cumsum(n)] = turn[0] = True  # ranges end with their chunk
    p = np.flatnonzero(hit & (turn[:-1] | (edge[:-1] == 1)))
    q = np.flatnonzero(hit & (turn[1:] | (edge[1:] == -1))) + 1
    o = owner[p]
    a = x["start"][o].astype(np.int64) + begin[p] - here[o]
    return _spans(x[o], a, a + (q - p) + width - 1)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the covered ranges out."""
    release()
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "sha", "text")}
        for t, *found in zip(b.column("text").to_pylist(), b.column("ranges"), b.column("more"), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            ranges = [np.frombuffer(v.as_buffer(), np.int32).reshape(-1, 2) for x in found if x.is_valid for v in x.values]
            kept, removed, spans, last = [], 0, 0, 0
            if ranges:
                a, z = np.concatenate(ranges).astype(np.int64).T
                order = np.argsort(a)
                a, z = a[order], np.maximum.accumulate(z[order])
                head = np.ones(len(a), bool)
                head[1:] = a[1:] > z[:-1]
                for x, y in zip(a[head].tolist(), np.append(z[:-1][head[1:]], z[-1]).tolist(), strict=True):
                    kept.append(raw[last:x])
                    removed, spans, last = removed + y - x, spans + 1, y
            kept.append(raw[last:])
            rest = b"".join(kept) if removed else raw
            for c, v in zip(out, (len(raw), removed, spans, rest if removed else None, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if removed else t), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.string()), b.column("rest")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "text", "rest"])


def dedup(docs: DataFrame, width: int = 200, buckets: int | None = None, carry: bool = False, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256), one for each row of docs.

    kept holds the remaining bytes where some were removed, and is null where the text stays as it is; text is
    what remains, without characters that lost a byte; with carry, rest has the other columns of docs."""
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")] if carry else []
    # the other columns travel in one struct, so their names can't clash with ours
    rest = F.struct(*[docs[c] for c in others]) if others else F.lit(None).cast("int")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest")).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.hash("text").alias("tag"), "text", "rest")
    # buckets are groups in a task's memory, so their number follows the input, and so do the tasks that read them
    n = max(16, buckets or 4 * partitions_of(source))
    posted = source.select("id", "tag", "text").mapInArrow(lambda it: _chunk_postings(it, width, n, hot), "bucket int, kind int, postings binary")
    found = posted.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _pass_1(t, width, hot), _RANGES)
    # each step is written, so its shuffle files go before the next one shuffles the texts
    found = materialise(found.groupBy("id", "tag").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("asked").alias("asked")), "ranges", tidy=True)
    asked = source.select("id", "tag", "text").join(found.where(F.size("asked") > 0).select("id", "tag", "asked"), ["id", "tag"]).mapInArrow(lambda it: _asked_chunks(it, width, n), "bucket int, postings binary, chunks binary")
    more = asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda key, t: (_pass_2_dealt if key[0].as_py() >= n else _pass_2)(t, width), _RANGES)
    more = materialise(more.groupBy("id", "tag").agg(F.collect_list("ranges").alias("more")), "more", tidy=True)
    full = source.join(found.drop("asked"), ["id", "tag"], "left")
    kind = source.schema["rest"].dataType.simpleString()
    return full.join(more, ["id", "tag"], "left").select("doc_id", "text", "ranges", "more", "rest").mapInArrow(_removed, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, text string, rest {kind}")


def clean(docs: DataFrame, width: int = 200) -> DataFrame:
    """docs with the repeated bytes cut out of text, characters that lost a byte dropped, and n_chars, where there is
    such a column, as it then is; all rows and columns."""
    cut = dedup(docs, width, carry=True)
    names = {c.lower(): c for c in docs.columns}
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text")}
    return cut.select(*[(new[low] if low in new else F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) for low, c in names.items()])
