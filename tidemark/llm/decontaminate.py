"""Benchmark decontamination: a broadcast hash set of test n-grams, against every window of the documents.

The n-grams are windows of `width` consecutive words of benchmark items; an item with fewer words is one
window. Words are runs of ASCII letters and digits (A-Z lowered) and of all bytes from 0x80 on. Documents are
looked through by the benchmark's own vocabulary: a word outside it ends a run, and only windows inside runs
are hashed and looked up; a hit is verified word by word against the item.

The set is broadcast only while it has at most MOST_WINDOWS windows, which is checked. A larger benchmark is
split into parts of that size, a long item too, each part a pass of its own over the documents; the driver holds a
part and a partition of items at a time.

Defined cases: null text or an item without words has no words and no windows; an item counts once however
often it occurs; rows of the benchmark that share an item_id count as one item; rows of the documents that
share a doc_id, and repeated rows, each give a row; a text of any length is read whole by one task; of items with
the same words each counts; other columns are ignored by hits() and kept by remove_documents(), whatever their names;
an empty table gives no rows, an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, release, texts

#: Windows of a broadcast set: about 100 MB.
MOST_WINDOWS = 500_000
#: Windows of a text that are hashed at a time.
_BLOCK = 1 << 16
#: Separators become spaces and A-Z are lowered.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text and where its words start and end."""
    raw = text.encode("utf-8", "surrogatepass")
    free = np.frombuffer(raw.translate(_TABLE), np.uint8) == 32
    edge = np.diff(np.concatenate(([True], free, [True])).astype(np.int8))
    return raw, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class Benchmark:
    """Windows of the items, by length: hash to window, window to items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text or "")]
            n = min(width, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                of = self.windows.setdefault(n, {}).setdefault(tuple(w[i : i + n]), [])
                if name not in of:
                    of.append(name)
        self.hashes = {n: np.unique(self._hash(np.array(list(t), np.uint64).reshape(-1, n))) for n, t in self.windows.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for i in range(rows.shape[1]):
            h = (h ^ rows[:, i]) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def find(self, text_words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        n = len(text_words)
        hit, items = np.zeros(n, bool), set()
        ids = np.fromiter(map(self.vocabulary.get, text_words, (0,) * n), np.int64, n)
        if not ids.any():
            return hit, items
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if n >= size else np.zeros(0, np.int64)
            if not len(at):
                continue
            for low in range(0, len(at), _BLOCK):
                part = at[low : low + _BLOCK]
                h = self._hash(ids[part[:, None] + np.arange(size)].astype(np.uint64))
                where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for p in part[hashes[where] == h].tolist():
                    if (of := self.windows[size].get(tuple(ids[p : p + size].tolist()))) is not None:
                        hit[p : p + size] = True
                        items.update(of)
        return hit, items


def _marked(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Add the words that one part of the benchmark hits, as a bit each, and the items found in it."""
    release()
    part: Benchmark = shared.value
    for b in batches:
        bits, names = [], []
        for text, before, known in zip(b.column("text").to_pylist(), b.column("bits").to_pylist(), b.column("items").to_pylist(), strict=True):
            hit, items = part.find(words(text))
            if before is not None:
                hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(hit)).astype(bool)
            bits.append(np.packbits(hit).tobytes() if hit.any() else None)
            names.append(sorted({*(known or ()), *items}) if items or known else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "bits", "items"])


def _digested(batches: Iterator[pa.RecordBatch], shared, cut: bool) -> Iterator[pa.RecordBatch]:
    """The last part of the benchmark, and what all parts have found."""
    release()
    part: Benchmark = shared.value
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        kept = []
        for text, before, known in zip(b.column("text").to_pylist(), b.column("bits").to_pylist(), b.column("items").to_pylist(), strict=True):
            w = words(text)
            hit, items = part.find(w)
            if before is not None:
                hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(hit)).astype(bool)
            items |= {*(known or ())}
            out["n_words"].append(len(w))
            out["n_hit"].append(int(hit.sum()))
            out["n_items"].append(len(items))
            out["items_sha256"].append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            out["contaminated"].append(bool(hit.any()))
            if cut:
                kept.append(_without(text, hit) if hit.any() else text)
        cols = {"doc_id": b.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_hit": pa.array(out["n_hit"], pa.int64()), "n_items": pa.array(out["n_items"], pa.int64()), "items_sha256": pa.array(out["items_sha256"], pa.string()), "contaminated": pa.array(out["contaminated"], pa.bool_())}
        yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.string())} if cut else {}))


def _without(text: str, hit: np.ndarray) -> str:
    """The text without the runs of hit words and what stands between them."""
    raw, start, end = _spans(text)
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    out, last = [], 0
    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(raw[last : start[a]])
        last = end[z - 1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def _parts(benchmark: DataFrame, width: int) -> Iterator[Benchmark]:
    """The benchmark in parts of at most MOST_WINDOWS windows, read item by item."""
    items, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").orderBy("i").toLocalIterator():
        w = words(r["t"])
        for at in range(0, max(1, len(w) - width + 1), MOST_WINDOWS):
            piece = w[at : at + MOST_WINDOWS + width - 1]
            size = max(1, len(piece) - width + 1)
            if items and n + size > MOST_WINDOWS:
                yield Benchmark(items, width)
                items, n = [], 0
            items.append((r["i"], b" ".join(piece).decode("utf-8", "surrogatepass")))
            n += size
    yield Benchmark(items, width)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, cut: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), with cut also kept: the text without hit spans."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", kept string" * cut
    rows = texts(docs).select("doc_id", "text", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<string>").alias("items"))
    parts = _parts(benchmark, width)
    part = next(parts)
    for following in parts:  # only beyond MOST_WINDOWS: a pass for each part
        shared = spark.sparkContext.broadcast(part)
        rows, part = materialise(rows.mapInArrow(lambda it, s=shared: _marked(it, s), "doc_id long, text string, bits binary, items array<string>"), "decontaminated"), following
        shared.unpersist()
    shared = spark.sparkContext.broadcast(part)
    return rows.mapInArrow(lambda it: _digested(it, shared, cut), schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs without a hit; all columns as they are. A pass for each part of the benchmark."""
    spark = docs.sparkSession
    prepare(spark)

    def kept(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        release()
        part: Benchmark = shared.value
        for b in batches:
            yield b.filter(pa.array([not part.find(words(t or ""))[0].any() for t in b.column("text").cast(pa.string()).to_pylist()], pa.bool_()))

    for part in _parts(benchmark, width):
        docs = docs.mapInArrow(lambda it, s=spark.sparkContext.broadcast(part): kept(it, s), docs.schema)
    return docs
