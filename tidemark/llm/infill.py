"""Fill-in-middle transformation by a parallel automaton scan.

Units are [A-Za-z]+|[^A-Za-z]. A text is cut into chunks anywhere between characters, and a chunk doesn't know how the
one before it ended. So its scan gives a function: for each state that it may be entered in, the state it ends in, the
units that begin in it, and whether a sentinel ends in it. The automaton has four states: after a character that is
neither of the following, inside letters, after "<", and after "<P", "<S" or "<M". Composing functions is associative, so the
functions of a document's chunks, a few numbers each, give its units, its sentinels and each chunk's entry state. The
cuts are then searched only in the chunks that hold them.

A document of at most CHUNK bytes is one chunk: its task scans, cuts and writes it in one pass over the table. The chunks of
longer ones are dealt out over the cluster and written; their functions are grouped by document (a document has at most
2 GB / CHUNK of them), the chunks that hold a cut are read again, and the cuts are joined with the document's text by
doc_id and SHA-256. No text is shuffled but of documents longer than a chunk.

The form and the cuts depend on doc_id and the number of units alone: h1 to h4 are the first four 8-digit groups of the
hex sha256 of "1:doc_id"; the prefix ends after min(h1 % (n + 1), h2 % (n + 1)) units, the middle after the larger.

Defined cases: a null text is empty and stays plain, as does a text that holds a sentinel; a null doc_id counts as an
empty number; rows that share a doc_id, and repeated rows, are transformed one by one, equal rows alike; other columns are
ignored by transform(), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_ids, materialise, prepare, release, texts

#: The sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Share of documents, in hundredths, that are transformed, and of those, that have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk.
CHUNK = 1 << 18
#: States of the automaton.
OTHER, LETTERS, OPENED, NAMED = range(4)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_NAME = np.zeros(256, bool)
_NAME[[80, 83, 77]] = True


def begins(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts one after the other; `first`: where the texts begin, entered in OTHER."""
    letter = _LETTER[raw]
    inside = np.zeros(len(raw), bool)
    inside[1:] = letter[:-1]
    inside[first] = False
    return ((raw & 0xC0) != 0x80) & ~(letter & inside)


def function(raw: np.ndarray) -> tuple[list[int], list[int], list[bool]]:
    """A chunk's end state, units and sentinels by entry state; an empty chunk changes nothing."""
    n = len(raw)
    if not n:
        return [*range(4)], [0] * 4, [False] * 4
    units = int(begins(raw, np.zeros(1, np.int64)).sum())
    starts_inside = bool(_LETTER[raw[0]])
    named = _NAME[raw]
    whole = bool(((raw[:-2] == 60) & named[1:-1] & (raw[2:] == 62)).any()) if n > 2 else False
    ends, counts, found = [], [], []
    for entry in range(4):
        # what came before matters for the first two bytes only
        before = {OTHER: b"", LETTERS: b"a", OPENED: b"<", NAMED: b"<P"}[entry]
        tail = before + raw[:2].tobytes() if n < 2 else raw[-2:].tobytes()
        head = before + raw[:2].tobytes()
        ends.append(_state(tail))
        counts.append(units - (starts_inside and entry in (LETTERS, NAMED)))
        found.append(whole or any(head[i : i + 3] in (PREFIX, SUFFIX, MIDDLE) for i in range(len(head) - 2)))
    return ends, counts, found


def _state(tail: bytes) -> int:
    """The state after a text, from its last two bytes at least."""
    if tail[-1:] == b"<":
        return OPENED
    if tail[-2:] in (b"<P", b"<S", b"<M"):
        return NAMED
    return LETTERS if tail and _LETTER[tail[-1]] else OTHER


def composed(f: tuple, g: tuple) -> tuple:
    """First f, then g; associative."""
    return [g[0][s] for s in f[0]], [n + g[1][s] for n, s in zip(f[1], f[0], strict=True)], [x or g[2][s] for x, s in zip(f[2], f[0], strict=True)]


def choice(doc_id: int | None, n: int) -> tuple[int, int, int, int]:
    """Units of the prefix, units up to the middle's end, and the draws of the transformation and its order."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = a % (n + 1), b % (n + 1)
    return min(a, b), max(a, b), c % 100, d % 100


def form_of(n: int, found: bool, c: int, d: int) -> str:
    return "plain" if not n or found or c >= TRANSFORMED else "spm" if d < SUFFIX_FIRST else "psm"


def written(raw: bytes, form: str, a: int, b: int) -> bytes:
    """The output of a text whose prefix ends at byte a and whose middle ends at byte b."""
    if form == "plain":
        return raw
    parts = (PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b])
    return b"".join(parts if form == "psm" else (*parts[2:4], *parts[:2], *parts[4:]))


def restored(output: bytes, form: str) -> bytes:
    """The text, rebuilt from output and form alone; none of its parts holds a sentinel."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


class _Rows:
    """Rows of the result; the text of the output only where it is asked for."""

    def __init__(self, outputs: bool):
        self.outputs, self.rows = outputs, []

    def add(self, doc_id: int | None, raw: bytes, n: int, form: str, a: int, b: int) -> None:
        plain = form == "plain"
        chars = (None, None) if plain else (len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[a:b].decode("utf-8", "surrogatepass")))
        output = written(raw, form, a, b)
        self.rows.append((doc_id, n, form, *chars, output.decode("utf-8", "surrogatepass") if self.outputs else None, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest()))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _OUT.split(", ")])


def _short(batches: Iterator[pa.RecordBatch], outputs: bool) -> Iterator[pa.RecordBatch]:
    """Documents of one chunk."""
    release()
    for batch in batches:
        out = _Rows(outputs)
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            raw = np.frombuffer(data, np.uint8)
            _, counts, found = function(raw)
            n = counts[OTHER]
            a, b, c, d = choice(doc_id, n)
            form = form_of(n, found[OTHER], c, d)
            if form != "plain":
                at = np.append(np.flatnonzero(begins(raw, np.zeros(1, np.int64))), len(raw))
                a, b = int(at[a]), int(at[b])
            out.add(doc_id, data, n, form, a, b)
        yield out.batch()


def _cut_up(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, chunk, data): the chunks of long documents, cut between characters."""
    release()
    for batch in batches:
        for r in range(batch.num_rows):
            data = batch.column("text")[r].as_buffer().to_pybytes()
            low, k = 0, 0
            while low < len(data):
                high = min(len(data), low + size)
                while high < len(data) and data[high] & 0xC0 == 0x80:
                    high += 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r, 1), batch.column("key").slice(r, 1), pa.array([k], pa.int32()), pa.array([data[low:high]], pa.binary())], ["doc_id", "key", "chunk", "data"])
                low, k = high, k + 1


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's function and bytes."""
    release()
    for batch in batches:
        made = [function(np.frombuffer(x.as_buffer(), np.uint8)) for x in batch.column("data")]
        size = pa.array([len(x.as_buffer()) for x in batch.column("data")], pa.int64())
        lists = [pa.array([f[i] for f in made], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "chunk")), *lists, size], ["doc_id", "key", "chunk", "ends", "counts", "found", "size"])


_CUTS = "key string, n long, form string, which int, chunk int, entry int, unit long, base long"


def _resolve(table: pa.Table) -> pa.Table:
    """Compose the functions of one document's chunks: its units and form, and for both cuts the chunk that holds it.

    A cut before unit u (u = n: the end of the text) lies in the chunk where unit u begins, at its `unit`-th beginning."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    before = [([*range(4)], [0] * 4, [False] * 4)]  # of the chunks up to each one
    for r in rows:
        before.append(composed(before[-1], (r["ends"], r["counts"], r["found"])))
    n, base = before[-1][1][OTHER], np.concatenate(([0], np.cumsum([r["size"] for r in rows]))).tolist()
    a, b, c, d = choice(rows[0]["doc_id"], n)
    form = form_of(n, before[-1][2][OTHER], c, d)
    units = [f[1][OTHER] for f in before]
    out = []
    for which, u in enumerate((a, b)):
        if u == n or form == "plain":
            k, unit, at = -1, 0, base[-1]
        else:
            k = int(np.searchsorted(units, u, "right")) - 1
            unit, at = u - units[k], base[k]
        out.append({"key": rows[0]["key"], "n": n, "form": form, "which": which, "chunk": k, "entry": before[k][0][OTHER] if k >= 0 else OTHER, "unit": unit, "base": at})
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("which", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()), ("unit", pa.int64()), ("base", pa.int64())]))


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte of each cut, counted from its document's beginning."""
    release()
    for batch in batches:
        at = []
        for data, entry, unit, base in zip(batch.column("data"), *(batch.column(c).to_pylist() for c in ("entry", "unit", "base")), strict=True):
            raw = np.frombuffer(data.as_buffer(), np.uint8)
            starts = begins(raw, np.zeros(1, np.int64))
            starts[0] &= not (_LETTER[raw[0]] and entry in (LETTERS, NAMED))
            at.append(base + int(np.flatnonzero(starts)[unit]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "form", "which")), pa.array(at, pa.int64())], ["key", "n", "form", "which", "at"])


def _joined(batches: Iterator[pa.RecordBatch], outputs: bool) -> Iterator[pa.RecordBatch]:
    """Long documents with their cuts."""
    release()
    for batch in batches:
        for r in range(batch.num_rows):  # a batch for each, as they are long
            out, of = _Rows(outputs), {c: batch.column(c)[r].as_py() for c in ("doc_id", "n", "form", "a", "b")}
            out.add(of["doc_id"], batch.column("text")[r].as_buffer().to_pybytes(), of["n"], of["form"], of["a"], of["b"])
            yield out.batch()


def transform(docs: DataFrame, outputs: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256); without outputs, output is null."""
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs)
    long_ = F.octet_length("text") > chunk
    short = rows.where(~long_).mapInArrow(lambda it: _short(it, outputs), _OUT)
    named = rows.where(long_).withColumn("key", F.concat_ws(":", F.sha2("text", 256), "doc_id"))
    chunks = materialise(named.mapInArrow(lambda it: _cut_up(it, chunk), "doc_id long, key string, chunk int, data binary").repartition("key", "chunk"), "chunks")
    scans = chunks.mapInArrow(_scanned, "doc_id long, key string, chunk int, ends array<int>, counts array<long>, found array<boolean>, size long")
    one = scans.groupBy("key", "chunk").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "ends", "counts", "found", "size")])  # equal rows have equal chunks
    cuts = materialise(one.groupBy("key").applyInArrow(_resolve, _CUTS), "cuts")
    held = join_ids(chunks.select("key", "chunk", "data"), cuts.where("chunk >= 0"), ["key", "chunk"], "inner")
    found = held.mapInArrow(_selected, "key string, n long, form string, which int, at long").unionByName(cuts.where("chunk < 0").select("key", "n", "form", "which", F.col("base").alias("at")))
    both = found.groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("form").alias("form"), *[F.max(F.when(F.col("which") == w, F.col("at"))).alias(c) for w, c in enumerate("ab")])
    whole = join_ids(named, materialise(both, "selected"), "key", "inner").select("doc_id", "text", "n", "form", "a", "b")
    return short.unionByName(whole.mapInArrow(lambda it: _joined(it, outputs), _OUT))


def digests(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of transform() without the texts."""
    return transform(docs, outputs=False, chunk=chunk).drop("output")
