"""N-gram Jaccard join: a size-aware heavy-light set similarity join, exact at any size.

A document's set holds its distinct k-word shingles. Two documents link when den * |A & B| >= num * |A | B|.

* Equal sets form a class; one member stands for it. They are found by grouping, never by pairing.
* Light sets (at most B shingles) enumerate their subsets of each size that an overlap with a partner must
  reach. Linked light sets share such a subset.
* Heavy sets, and light ones that may link with a heavy one, are scanned through inverted lists. A list's
  key is a block: all shingles of a set whose hashes fall in one of m equal ranges. m exceeds the largest
  symmetric difference that linked sets of the size class may have, so linked sets share whole blocks, and
  more of them than there are empty ones, which need not be listed.
  Single shingles as keys would give lists as long as the commonest phrase is frequent; whole blocks don't.
* B is the boundary with the least number of keys over the sizes that occur.

Lists give candidates: first every member with the smallest of its list, verified on whole sets. A list of HOT
members or more within a task sends only its smallest one on: the others are tied to that one there, once for all
such lists, so a list that a third of the documents share stays spread out. Members of a list of three or more that
are in different components afterwards go through a second, finer scan: their shingles are put in order, the rarest among them first, and a list holds, for one shingle and two ranges of sizes, the sets
that have it early enough for the overlap that such sizes need. There every member is verified with the one
of fewest shingles of its own, and what then is in different components pair by pair, so no link is lost,
while a large group of near copies never becomes all its pairs. Components come from star contraction.

Defined cases: null text, or text without words, has an empty set, links with nothing and is its own
component; fewer words than k make one shingle of the whole sequence; rows that share a doc_id are told apart by
their sets, and each gets the component of its own; repeated rows are equal sets and each keeps its row; a row
without a doc_id gets the component of an equal set that has one, else none; texts of any length are read whole, in runs
of about 0.5 MB; other columns are ignored, whatever their names; an empty table gives no rows. keep_one() keeps rows
whose doc_id is the smallest of their component, and rows without a doc_id or without words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import textops
from .common import join_ids, partitions_of, prepare, release, scratch, texts
from .common import materialise as written

#: Sets of more shingles are always heavy.
LIGHT_MOST = 40
#: Sketches count shingles in 2**SKETCH_BITS ranges of their hashes.
SKETCH_BITS = 10
#: Postings that a task holds before it hands them on.
FLUSH = 1 << 19
#: Members of a list in what a task holds, from which it is tied together there.
HOT = 32
#: Sets that a task remembers, so that equal sets post once a task.
SEEN = 200_000
_FEATURES = "doc_id long, tag long, n_shingles long, set_key binary, name long"
#: A list's key and a member, the first 64 bits of its set_key; of a list whose members are tied, the member they are tied
#: to. Sets of one name are candidates of all that either is, and of each other.
_POSTING = np.dtype([("key", "<u8"), ("name", "<u8")])
#: A member and the one that it is tied to.
_TIE = np.dtype([("center", "<u8"), ("name", "<u8")])


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a table; each step reads the tables of the steps before it only, so its shuffle files go with it."""
    return written(df, label, tidy=True, keep=keep)


class Sizes:
    """What follows from the threshold num/den and the boundary for sets of each size."""

    def __init__(self, num: int, den: int, light: int = 0):
        self.num, self.den, self.light = num, den, light
        self.starts: list[int] = []  # of the size classes for blocks
        self._blocks: dict[int, tuple[int, int]] = {}
        low = max(1, -(-(light + 1) * num // den))
        self.starts.append(low)

    def overlap(self, s: int, t: int) -> int:
        """The least overlap of linked sets of s and t shingles."""
        return -(-self.num * (s + t) // (self.num + self.den))

    def partners(self, s: int) -> range:
        return range(-(-s * self.num // self.den), s * self.den // self.num + 1)

    def subset_sizes(self, s: int, light: int) -> list[int]:
        return sorted({c for t in self.partners(s) if 0 < t <= light and (c := self.overlap(s, t)) <= min(s, t)})

    def subsets(self, s: int, light: int) -> int:
        return sum(comb(s, c) for c in self.subset_sizes(s, light))

    def class_of(self, s: int) -> int:
        while self.starts[-1] <= s:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * self.den // self.num + 1))
        return int(np.searchsorted(self.starts, s, "right")) - 1

    def blocks(self, k: int) -> tuple[int, int]:
        """Blocks of class k, and how many of them are spare: beyond one more than linked sets can differ by.

        A set passes over its empty blocks, unless it has more of them than are spare; of linked sets' equal
        blocks one more is there than are spare, so one that both list remains."""
        if k not in self._blocks:
            while len(self.starts) <= k + 1:
                self.class_of(self.starts[-1])
            low, top = self.starts[k], self.starts[k + 1] - 1
            differ = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            spare = 2
            while True:
                m = differ + 1 + spare
                empty = m * exp(-low / m)  # expected in a set of the smallest size
                if empty + 4 * sqrt(empty) <= spare or spare > differ:
                    break
                spare += 1
            self._blocks[k] = (m, spare)
        return self._blocks[k]

    def classes(self, s: int) -> range:
        """Size classes in which a set of s shingles lists its blocks: its own and those of smaller partners."""
        if s * self.den // self.num <= self.light or s < self.starts[0]:
            return range(0)
        return range(self.class_of(max(self.starts[0], -(-s * self.num // self.den))), self.class_of(s) + 1)


def choose_boundary(counts: dict[int, int], num: int, den: int) -> int:
    """The light boundary with the fewest keys: subsets up to it, blocks where a partner may be beyond it."""

    def cost(light: int) -> int:
        z = Sizes(num, den, light)
        return sum(n * ((z.subsets(s, light) if s <= light else 0) + sum(z.blocks(k)[0] for k in z.classes(s))) for s, n in counts.items())

    return min(range(LIGHT_MOST + 1), key=lambda b: (cost(b), b))


def _subset_keys(h: np.ndarray, sizes: list[int]) -> list[int]:
    """Keys of the subsets of each size, by what is left out; a subset's key is the sum of scrambled members."""
    from itertools import combinations

    scrambled = textops.mix(h)
    with np.errstate(over="ignore"):
        total = scrambled.sum(dtype=np.uint64)
        out = []
        for c in sizes:
            left = len(h) - c
            sums = np.zeros(1, np.uint64) if not left else scrambled[np.array(list(combinations(range(len(h)), left)))].sum(axis=1, dtype=np.uint64)
            out.append(textops.mix(total - sums + np.uint64(c) * np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_bounds: dict[int, np.ndarray] = {}


def _block_keys(h: np.ndarray, sums: np.ndarray, k: int, m: int, spare: int) -> np.ndarray:
    """Keys of the blocks of a sorted set in class k; sums: prefix sums of its scrambled members."""
    if m not in _bounds:
        _bounds[m] = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
    at = np.concatenate(([0], np.searchsorted(h, _bounds[m]), [len(h)]))
    keys = textops.mix(sums[at[1:]] - sums[at[:-1]] + textops.mix(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32)))
    full = np.diff(at) > 0
    return keys[full] if m - int(full.sum()) <= spare else keys


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        size, key = [], []
        for _, _, raw, ends in textops.slices(b.column("text"), textops.SHORT_RUN):
            h, at = textops.shingle_sets(raw, ends, k)
            size.append(np.diff(at))
            key += [xxhash.xxh3_128_digest(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        n = np.concatenate(size) if size else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(np.frombuffer(b"".join(key), ">i8")[::2].astype(np.int64))], ["doc_id", "tag", "n_shingles", "set_key", "name"])


def _postings(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, light: int, buckets: int, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, postings, ties, tied) of the keys of all sets, bucket by bucket; tied: lists with their members' center."""
    release()
    z = Sizes(num, den, light)
    held: dict[bytes, np.ndarray] = {}  # keys by set
    seen: set[bytes] = set()
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        # sets in order, then a stable sort by key: members of a list are in order, too
        marks = sorted(held)
        keys = np.concatenate([held[m] for m in marks])
        owner = np.repeat(np.arange(len(marks)), [len(held[m]) for m in marks])
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        x = np.empty(int(new.sum()), _POSTING)
        names = np.frombuffer(b"".join(marks), ">u8")[::2].astype(np.uint64)
        x["key"], x["name"] = keys[new], names[owner[new]]
        head = np.ones(len(x), bool)
        head[1:] = x["key"][1:] != x["key"][:-1]
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(x)))
        member = np.repeat(count >= hot, count) & ~head
        owner = owner[new]
        pair = np.unique(owner[np.repeat(start, count)[member]] * len(marks) + owner[member])
        ties, tied = np.empty(len(pair), _TIE), x[start[count >= hot]]
        ties["center"], ties["name"] = names[pair // len(marks)], names[pair % len(marks)]
        x = x[~member]
        of = lambda v: v % np.uint64(buckets)
        rows = [*_blobs(x, of(x["key"]), 1), *_blobs(ties, of(ties["name"]), 2), *_blobs(tied, of(tied["key"]), 3)]
        for i in range(0, len(rows), 256):
            bucket, *blobs = zip(*rows[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(v, pa.binary()) for v in blobs)], ["bucket", "postings", "ties", "tied"])

    for b in batches:
        known = b.column("doc_id").is_valid().to_pylist()
        for row, _, raw, ends in textops.slices(b.column("text"), textops.SHORT_RUN):
            h, at = textops.shingle_sets(raw, ends, k)
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(textops.mix(h), out=sums[1:])
            for r, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = h[i:j]
                if i == j or not known[row + r]:
                    continue
                mark = xxhash.xxh3_128_digest(own)
                if mark in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
                s = j - i
                new = [_block_keys(own, sums[i : j + 1], c, *z.blocks(c)) for c in z.classes(s)]
                if s <= light:
                    new.append(_subset_keys(own, z.subset_sizes(s, light)))
                if not new:
                    continue
                held[mark] = np.concatenate(new)
                size += len(held[mark])
            if size >= FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def _blobs(x: np.ndarray, bucket: np.ndarray, place: int) -> Iterator[tuple]:
    """(bucket, postings, ties, tied) of the buckets that occur, x in the place of one of them."""
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(x)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if i < j:
            yield (int(bucket[i]), *(x[i:j].tobytes() if k == place else None for k in (1, 2, 3)))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different rows, in order of their fields."""
    x = x[np.lexsort([x[f] for f in reversed(x.dtype.names)])]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _rows(blobs: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """The rows in blobs, one after the other; nulls have none."""
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(v.as_buffer(), dtype) for v in blobs.drop_null())])


def _lists(bucket: pa.Table) -> pa.Table:
    """Inverted lists of a bucket with two sets or more, each once: (list_id, center, member), center the smallest. Ties
    have no list_id, and lists with tied members no member."""
    x, ties, tied = (_rows(bucket.column(c), d) for c, d in (("postings", _POSTING), ("ties", _TIE), ("tied", _POSTING)))
    order = np.argsort(x["key"], kind="stable")
    key = x["key"][order]
    twice = np.zeros(len(key), bool)
    twice[1:] = key[1:] == key[:-1]
    twice[:-1] |= twice[1:].copy()
    x = _distinct(x[order[twice]])  # most keys have one member and end here
    head = np.ones(len(x), bool)
    head[1:] = x["key"][1:] != x["key"][:-1]
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(x)))
    seen: set[bytes] = set()
    keep = np.zeros(len(start), bool)
    with_ties = np.isin(x["key"][start], tied["key"])
    sets = np.ascontiguousarray(x["name"])
    for i in np.flatnonzero(size > 1).tolist():
        if with_ties[i]:
            keep[i] = True
        elif (mark := xxhash.xxh3_128_digest(sets[start[i] : start[i] + size[i]])) not in seen:
            seen.add(mark)
            keep[i] = True
    rows = np.repeat(keep, size)
    found, center = x[rows], x[np.repeat(start, size)[rows]]
    ties, tied = _distinct(ties), _distinct(tied)
    number = lambda v: pa.array(v.view(np.int64))
    return pa.table({"list_id": pa.concat_arrays([number(found["key"].copy()), pa.nulls(len(ties), pa.int64()), number(tied["key"].copy())]), "center": number(np.concatenate((center["name"], ties["center"], tied["name"]))), "member": pa.concat_arrays([number(found["name"].copy()), number(ties["name"].copy()), pa.nulls(len(tied), pa.int64())])})


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted rows, with a sketch each: how many shingles fall in each of SKETCH ranges."""
    release()
    for b in batches:
        for row, last, raw, ends in textops.slices(b.column("text"), textops.SHORT_RUN):
            h, at = textops.shingle_sets(raw, ends, k)
            out: list[tuple] = []
            for name, want, i, j in zip(b.column("set_id").slice(row, last - row).to_pylist(), b.column("set_key").slice(row, last - row).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = h[i:j]
                if xxhash.xxh3_128_digest(own) == want:
                    sketch = np.minimum(np.bincount((own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS), 255).astype(np.uint8)
                    out.append((name, j - i, sketch.tobytes(), own.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["set_id", "size", "sketch", "shingles"])


def _possible(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow the overlap that a link needs: no set shares more of a range than either has there."""
    release()
    for b in batches:
        keep = []
        for x, y, m, n in zip(b.column("sketch_a"), b.column("sketch_b"), b.column("size_a").to_pylist(), b.column("size_b").to_pylist(), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            least = np.minimum(p, q)
            o = min(m, n) if least.max(initial=0) == 255 else int(least.sum(dtype=np.int64))
            keep.append(den * o >= num * (m + n - o))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        keep = []
        for x, y in zip(b.column("shingles_a"), b.column("shingles_b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((p, q))
            both.sort(kind="stable")
            o = int((both[1:] == both[:-1]).sum())
            keep.append(den * o >= num * (len(p) + len(q) - o))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("doc").to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["doc", "shingle"])


#: Sizes of one range differ by at most this part.
_RANGE = 1.025


def _size_range(n: int) -> int:
    return int(np.log(n) / np.log(_RANGE))


_KEYS = "shingle long, low int, high int, doc long, size long, place long, alone long"


def _early(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Lists of each set: its shingles in rarest-first order, as far as a partner's size lets the first common one stand."""
    release()
    z = Sizes(num, den)
    names = [x.split() for x in _KEYS.split(", ")]
    for b in batches:
        for at in range(0, b.num_rows, 64):  # few sets at a time, as numbers in arrays: a set may have very many keys
            part, rows = b.slice(at, 64), []
            for doc, size, shared in zip(part.column("doc").to_pylist(), part.column("size").to_pylist(), part.column("shared"), strict=True):
                order = np.zeros(0, np.int64)
                if shared.is_valid:
                    n, order = (shared.values.field(c).to_numpy() for c in ("n", "shingle"))
                    order = order[np.lexsort((order, n))]
                alone = size - len(order)
                least: dict[int, int] = {}  # by range of the partner's size: the least overlap
                for t in z.partners(size):
                    if t > 0 and (o := z.overlap(size, t)) <= min(size, t):
                        r = _size_range(t)
                        least[r] = min(least.get(r, o), o)
                own = _size_range(size)
                for r, o in least.items():
                    place = np.arange(alone, size - o + 1)
                    rows.append((order[place - alone], *(np.full(len(place), v) for v in (min(own, r), max(own, r), doc, size)), place, np.full(len(place), alone)))
            if rows:
                columns = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if kind == "int" else np.int64)) for c, (_, kind) in zip(columns, names, strict=True)], [name for name, _ in names])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the smallest node it reaches, by star contraction.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours; the
    edges end as stars around the smallest nodes."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, large.a == least.n)
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        seen = Observation()
        e = materialise(small.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        if seen.get == mark:
            break
        mark = seen.get
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs (doc_id, text)."""
    return _components_of_rows(docs, words, num, den, buckets, hot).drop("tag")


def _components_of_rows(docs: DataFrame, words: int, num: int, den: int, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """The same with tag, a hash of the row's text."""
    prepare(docs.sparkSession)
    source = texts(docs)
    # buckets are groups in a task's memory, so their number follows the input, and so do the tasks that read them
    n_buckets = max(16, buckets or 4 * partitions_of(source))
    features = materialise(source.withColumn("tag", F.xxhash64("text")).mapInArrow(lambda it: _features(it, words), _FEATURES), "sets")
    full = features.where("n_shingles > 0")
    # sets get a number each once they are written, and go by it from there on
    classes = materialise(full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("name").alias("name")).withColumn("set_id", F.monotonically_increasing_id()), "classes")
    light = choose_boundary({r[0]: r[1] for r in features.where(F.col("n_shingles").between(1, LIGHT_MOST * den // num + 1)).groupBy("n_shingles").count().collect()}, num, den)
    posted = source.mapInArrow(lambda it: _postings(it, words, num, den, light, n_buckets, hot), "bucket int, postings binary, ties binary, tied binary")
    lists = posted.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_lists, "list_id long, center long, member long")
    number = classes.select("name", "set_id")
    named = lists.join(number.select(F.col("name").alias("member"), F.col("set_id").alias("b")), "member", "left").join(number.select(F.col("name").alias("center"), F.col("set_id").alias("a")), "center").select("list_id", "a", "b")
    named = materialise(named, "lists")
    same_name = number.groupBy("name").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).select("a", "b")
    edges = named.select("a", "b").union(same_name).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "candidates")
    wanted = edges.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes, "set_id")
    # a doc_id may have several texts: of those only the one of the wanted set stays
    sets = join_ids(source, materialise(wanted, "wanted"), "doc_id", "inner").mapInArrow(lambda it: _sets(it, words), "set_id long, size long, sketch binary, shingles binary")
    sets = materialise(sets, "shingles")
    side = lambda s, x, *columns: s.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    sizes = materialise(sets.select("set_id", "size").distinct(), "sizes")

    def verified(pairs: DataFrame) -> DataFrame:
        # sizes first, as many pairs end at them and sketches are large
        brief = pairs.join(side(sizes, "b", "size"), "b").join(side(sizes, "a", "size"), "a").where(f"least(size_a, size_b) * {den} >= greatest(size_a, size_b) * {num}")
        brief = brief.join(side(sets, "b", "sketch"), "b").join(side(sets, "a", "sketch"), "a")
        pairs = materialise(brief.mapInArrow(lambda it: _possible(it, num, den), "a long, b long"), "possible")
        # most sets are in no pair that is left, so only the others' shingles are shuffled
        asked = join_ids(sets, materialise(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "asked"), "set_id", "left_semi")
        full = pairs.join(side(asked, "b", "shingles"), "b").join(side(asked, "a", "shingles"), "a")
        return materialise(full.mapInArrow(lambda it: _verified(it, num, den), "a long, b long").distinct(), "links")

    links = verified(edges)
    # a list whose members all link with its smallest one, and theirs with them, is settled; the others go on
    linked = links.withColumn("linked", F.lit(True))
    missed = named.where("a <> b").select("list_id", F.col("a").alias("center"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(linked, ["a", "b"], "left").where("linked is null")
    missed = materialise(missed.select("list_id", F.when(F.col("list_id").isNull(), F.col("center")).alias("center")).distinct(), "missed")
    ties, tied = named.where("list_id is null").select("a", "b"), named.where("b is null").select("list_id", "a")
    # two members are a pair, which is settled either way once it is verified
    pairs = named.where("list_id is not null").groupBy("list_id").agg(F.count("*").alias("n"), F.max(F.col("b").isNull()).alias("tied")).where("n = 2 and not tied").select("list_id")
    failed = missed.where("list_id is not null").select("list_id").join(pairs, "list_id", "left_anti").union(tied.join(missed.where("list_id is null").select(F.col("center").alias("a")), "a").select("list_id")).distinct()
    failed = materialise(failed, "failed")
    members = named.where("b is not null").join(failed, "list_id").select(F.explode(F.array("a", "b")).alias("doc"))
    centers = tied.join(failed, "list_id").select("a").distinct()
    open_ = materialise(members.union(centers.select("a")).union(ties.join(centers, "a").select("b")).distinct(), "open")
    found = components(links) if open_.isEmpty() else _second_scan(open_, sets.select(F.col("set_id").alias("doc"), "shingles"), edges, links, verified, num, den)
    named_of = classes.select("set_key", "doc_id", "set_id").join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    smallest = named_of.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    of = named_of.join(smallest, "component", "left").select("set_key", F.coalesce("smallest", "doc_id").alias("component_id"))
    return features.join(of, "set_key", "left").select("doc_id", "tag", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _second_scan(open_: DataFrame, sets: DataFrame, edges: DataFrame, links: DataFrame, verified: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Components after the finer scan of the open sets (doc)."""
    # only the sets of repeated rows stand there more than once, so only those are shuffled
    again = materialise(sets.groupBy("doc").count().where("count > 1").select("doc"), "again")
    asked = join_ids(sets, open_, "doc", "left_semi")
    inside = materialise(join_ids(asked, again, "doc", "left_anti").union(join_ids(asked, again, "doc", "left_semi").dropDuplicates(["doc"])), "open")
    element = inside.select("doc", "shingles").mapInArrow(_elements, "doc long, shingle long")
    common = materialise(element.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    shared = element.join(common, "shingle").groupBy("doc").agg(F.collect_list(F.struct("n", "shingle")).alias("shared"))
    early = inside.select("doc", (F.octet_length("shingles") / 8).cast("long").alias("size")).join(shared, "doc", "left")
    keys = materialise(early.mapInArrow(lambda it: _early(it, num, den), _KEYS), "early")
    by = ["shingle", "low", "high"]

    centers = keys.groupBy(by).agg(F.count("*").alias("n"), F.min(F.struct("alone", "doc")).alias("c")).where("n > 1").select(*by, F.col("c.doc").alias("center"))
    keys = materialise(keys.join(centers, by), "shared")  # most lists have one set and end here
    first = keys.where("doc <> center").select(F.least("doc", "center").alias("a"), F.greatest("doc", "center").alias("b")).distinct().join(edges, ["a", "b"], "left_anti")
    first = materialise(first, "tried")
    links = links.union(verified(first))
    found = components(links)

    # a list goes on if a member's component is not its center's
    found = materialise(found, "found")
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    keys = join_ids(join_ids(keys, of("doc"), "doc", "left"), of("center"), "center", "left")
    keys = materialise(keys.select(*by, "doc", "size", "place", F.coalesce("of_doc", "doc").alias("component"), F.coalesce("of_center", "center").alias("main")), "early")
    mixed = materialise(keys.where("component <> main").select(*by).distinct(), "mixed")
    keys = materialise(keys.drop("main").join(mixed, by, "left_semi"), "early")
    # the largest component of a list need not be paired with itself
    main = keys.groupBy(*by, "component").count().groupBy(by).agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    listed = materialise(keys.join(main, by), "early")
    p, q = listed.where("component <> main").alias("p"), listed.alias("q")
    need = f"(({num} * (p.size + q.size) + {num + den - 1}) div {num + den})"
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in by]
    rest = p.join(q, [*same, F.expr(f"p.component <> q.component and (q.component = q.main or p.doc < q.doc) and p.size - p.place >= {need} and q.size - q.place >= {need} and least(p.size, q.size) >= {need}")])
    rest = rest.select(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b")).distinct().join(edges.union(first), ["a", "b"], "left_anti")
    more = verified(rest)
    return found if more.isEmpty() else components(links.union(more))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of docs that have the smallest doc_id of their component; all columns of docs."""
    with scratch(docs.sparkSession):  # the tables of the steps are many times what comes of them
        out = _components_of_rows(docs, words, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("out_id"), F.col("tag").alias("out_tag")).distinct()
        out = materialise(out, "copies", keep=True)
    # the columns of docs travel in one struct, so their names can't clash with ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("out_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("out_tag"))
    return join_ids(rows, out, ["out_id", "out_tag"], "left_anti").select("row.*")
