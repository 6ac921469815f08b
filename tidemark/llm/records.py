"""Token ids as length-delimited binary records, with an index of offsets for reads in any order.

A shard holds the records of a range of doc_ids, in order. A record is

    length of the payload, unsigned 64 bits | masked crc32 of those 8 bytes | payload | masked crc32 of the payload

all little-endian; a masked checksum is its value turned right by 15 bits plus 0xA282EAD8. A payload is the
doc_id (64 bits), the width of an id in bytes (2 or 4) and the ids. The index beside a shard has, for each
record, the doc_id, the offset of the record and the number of ids.

Shards are written by the tasks through Arrow's file systems, under names of their own attempt; the manifest
that the write returns names the shards of the attempts that succeeded, so a repeated task leaves nothing
that is read. It numbers the writing tasks, which hold ranges of doc_ids in order, and the shards of each, so
records of one doc_id that run over a shard's end keep their order. Readers check every checksum.

Defined cases: null text is empty: its record holds the end id alone; rows that share a doc_id, and repeated
rows, each give a record, in the order of their texts; null doc_ids come first, stored as the least 64-bit
integer; a text of any length is one record, held in memory by one task; other columns are ignored, whatever
their names; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .bpe import ByteEncoder
from .common import materialise, prepare, shared_dir, texts, worker_state

#: Bytes after which a shard is closed.
SHARD = 64 << 20
#: Chunks that a worker remembers: asking the library for one takes far longer than finding it, and few bytes are kept.
MOST = 800_000
_NONE = -(2**63)
_MANIFEST = "part long, number long, first_id long, shard string, n_records long, n_tokens long, n_bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"%b%b%b%b" % (head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)))


def payload(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qB", doc_id, width) + ids.astype(f"<u{width}", copy=False).tobytes()


def parse(data: bytes) -> tuple[int, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", data)
    return doc_id, np.frombuffer(data, f"<u{width}", offset=9)


def read_frame(source) -> bytes | None:
    """The next payload of a stream, or None at its end; an error where a checksum or length is wrong."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError("damaged length of a record")
    n = struct.unpack_from("<Q", head)[0]
    data = source.read(n + 4)
    if len(data) < n + 4 or struct.unpack_from("<I", data, n)[0] != masked(data[:n]):
        raise ValueError("damaged record")
    return data[:n]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class LibraryEncoder(ByteEncoder):
    """Ids by the tokenizers library, asked once for each chunk of text that a worker does not remember.

    Chunks are handed over together, one a line: the split pattern always cuts at a line end that stands
    between other characters, and its id tells the chunks apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._start({t.content: i for i, t in self.library.get_added_tokens_decoder().items()})
        self.table.most = MOST
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0]

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without the places in the text

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        simple: dict[bool, list[int]] = {True: [], False: []}
        for i, p in enumerate(pieces):
            q = p[1:] if p[0] in "\n " else p
            if not q or "\n" in q or q[0].isspace() or q[-1].isspace():
                out[i] = self._ids(p)
            else:
                simple[p[0] == " "].append(i)
        for spaced, at in simple.items():
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                # chunks after a space keep it only if it does not follow the line end: each gets a letter before it
                ids = self._ids("\n".join(("x" + pieces[i]) if spaced else pieces[i].lstrip("\n") for i in part))
                low = 0
                for i, high in zip(part, [*np.flatnonzero(np.array(ids) == self.line).tolist(), len(ids)], strict=True):
                    out[i] = ids[low + 1 : high] if spaced else [self.line, *ids[low:high]] if pieces[i][0] == "\n" else ids[low:high]
                    low = high + 1
        return out


def _encoder(path: str) -> LibraryEncoder:
    return worker_state(("records", path), lambda: LibraryEncoder(path))


class _Shard:
    def __init__(self, folder: str, part: int, number: int):
        self.name, self.part, self.number = f"part-{uuid.uuid4().hex}", part, number
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        self.files, self.path = files, f"{path}/{self.name}"
        self.out = files.open_output_stream(f"{self.path}.rec")
        self.index: list[tuple[int, int, int]] = []
        self.at = 0

    def add(self, doc_id: int, ids: np.ndarray, width: int) -> None:
        data = frame(payload(doc_id, ids, width))
        self.out.write(data)
        self.index.append((doc_id, self.at, len(ids)))
        self.at += len(data)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        table = np.array(self.index, "<i8")
        with self.files.open_output_stream(f"{self.path}.idx") as f:
            f.write(table.tobytes())
        row = {"part": self.part, "number": self.number, "first_id": self.index[0][0], "shard": self.name, "n_records": len(table), "n_tokens": int(table[:, 2].sum()), "n_bytes": self.at}
        return pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in row.items()})


def _written(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    e = _encoder(path)
    width = 2 if max(e.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    part, number, shard = TaskContext.get().partitionId(), 0, None
    for b in batches:
        for row, last, raw, ends in textops.slices(b.column("text")):
            ids, at = e.encode_run(raw, ends)
            n = last - row
            # the end id goes behind each text's ids
            ids = np.insert(ids.astype(f"<u{width}"), at[1:], end_id)
            at = at + np.arange(n + 1)
            for doc_id, x, y in zip(b.column("id").slice(row, n).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                shard = shard or _Shard(folder, part, number)
                shard.add(doc_id, ids[x:y], width)
                if shard.at >= shard_bytes:
                    yield shard.close()
                    shard, number = None, number + 1
    if shard:
        yield shard.close()


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD) -> tuple[str, DataFrame]:
    """Encode every text, append end_id, and write shards below folder in the order of doc_id.

    Returns the folder and its manifest: part, number (the order of the shards), first_id, shard, n_records, n_tokens,
    n_bytes, kept beside the shards."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or shared_dir(spark, "records")
    source = texts(docs).select(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), "text")
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    return folder, materialise(ordered.mapInArrow(lambda it: _written(it, folder, tokenizer, end_id, shard_bytes), _MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, path = _open(folder)
    for b in batches:
        for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), strict=True):
            with files.open_input_stream(f"{path}/{shard}.rec", buffer_size=1 << 20) as source:
                rows, start = [], base
                while (data := read_frame(source)) is not None:
                    doc_id, ids = parse(data)
                    rows.append((None if doc_id == _NONE else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the shards; start: ids of all records before.

    Sums run over the shards of a part and over the parts' totals: a row for each writing task meets in one task."""
    prepare(manifest.sparkSession)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))
    bases = manifest.withColumn("base", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part").select("shard", (F.col("first") + F.col("base")).alias("base"))
    return bases.repartition(max(1, manifest.count()), "shard").mapInArrow(lambda it: _read(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(folder: str, shard: str, position: int) -> tuple[int, np.ndarray]:
    """Record number `position` of a shard by its index, for reads in any order."""
    files, path = _open(folder)
    with files.open_input_file(f"{path}/{shard}.idx") as f:
        f.seek(24 * position)
        offset = struct.unpack("<qqq", f.read(24))[1]
    with files.open_input_file(f"{path}/{shard}.rec") as f:
        f.seek(offset)
        return parse(read_frame(f))
