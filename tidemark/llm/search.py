"""Ranked lexical search by inverted treaps: for each query the best documents, exactly.

Documents are dealt into shards as they lie. In a shard each term has a treap of its postings: a search tree by
document (the shard's documents in ascending doc_id), a heap by impact, so the root of any subtree has the largest
impact below it. A query walks the treaps of its terms together. A piece of work is an interval of documents with a
subtree of each term; the sum of the roots' impacts bounds every score in it, so a piece whose sum can't enter the
query's best k is dropped whole. Otherwise the document of the greatest root is scored, by descent in all treaps of the
piece, and the interval splits on both sides of it. Pieces of all queries are walked many at a time by numpy, those with
the highest bounds first; a task carries its best k from shard to shard and sends only these. The best of all tasks are
ranked by a window. No posting is shuffled and no document's text is read twice.

Terms are the runs of ASCII letters and digits (A-Z lowered) and of all bytes from 0x80 on. Scores are integers:
  w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
  m = 100 - b + (b * n * N) div L, b = 90
  score = sum over the query's terms of w * ((10**9 * tf) div (1000 * tf + 8 * m))

The queries' terms are broadcast; queries are split into parts of at most MOST_TERMS terms and MOST_QUERIES queries,
which is checked as they are read; each part is a pass of its own over the documents, so any number of queries works.

Defined cases: null text has no terms, and a document or query without terms is never found or answered; equal scores go
by ascending doc_id, a null doc_id last; rows of documents that share a doc_id, and repeated rows, are documents of their
own, each may be found; rows of the queries that share an id are one query, a null id is none; a text of any length is
read whole by one task; other columns are ignored, whatever their names; an empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, release, texts
from .decontaminate import words

#: Terms and queries of a pass; they are broadcast.
MOST_TERMS, MOST_QUERIES = 200_000, 2_000
#: Postings of a shard: about 100 MB while its treaps are built and walked.
SHARD_POSTINGS = 1_500_000
#: Pieces that are walked at a time.
_PIECES = 4_096
#: Queries that are walked together.
_TOGETHER = 256
_B = 90


def _parts(queries: DataFrame, key: str, text: str) -> Iterator[dict[str, list[bytes]]]:
    """The queries in parts, each as the terms of its queries, read row by row."""
    rows = queries.select(F.col(key).cast("string").alias("q"), F.col(text).cast("string").alias("t")).where("q is not null and t is not null").orderBy("q")
    part: dict[str, list[bytes]] = {}
    terms: set[bytes] = set()
    name, own = None, set()

    def full() -> bool:
        return bool(part) and (len(part) >= MOST_QUERIES or len(terms | own) > MOST_TERMS)

    for r in rows.toLocalIterator():
        if r["q"] != name:
            if own:
                if full():
                    yield part
                    part, terms = {}, set()
                part[name] = sorted(own)
                terms |= own
            name, own = r["q"], set()
        own |= {*words(r["t"])}
    if own:
        if full():
            yield part
            part = {}
        part[name] = sorted(own)
    if part:
        yield part


def _forward(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and the asked ones in it with their occurrences."""
    release()
    vocabulary: dict[bytes, int] = shared.value
    for b in batches:
        n, per = [], []
        for text in b.column("text").to_pylist():
            w = words(text or "")
            n.append(len(w))
            per.append(np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int64, len(w)))
        if not n:
            continue
        kinds = max(1, len(vocabulary))
        ids = np.concatenate(per)
        row = np.repeat(np.arange(len(n)), n)
        asked = ids >= 0
        both, tf = np.unique(row[asked] * kinds + ids[asked], return_counts=True)
        ends = np.searchsorted(both, np.arange(len(n) + 1) * kinds).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (both % kinds, tf)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])


def _children(term: np.ndarray, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children of the treaps of postings in order of (term, document), and the terms' roots."""
    n = len(term)
    left, right, roots, stack, last = [-1] * n, [-1] * n, [], [], None
    for i, (t, p) in enumerate(zip(term.tolist(), priority.tolist(), strict=True)):
        if t != last:
            if stack:
                roots.append(stack[0][1])
            stack, last = [], t
        below = -1
        while stack and stack[-1][0] < p:
            below = stack.pop()[1]
        left[i] = below
        if stack:
            right[stack[-1][1]] = i
        stack.append((p, i))
    if stack:
        roots.append(stack[0][1])
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m) of postings: what a term adds, but for its weight."""
    m = 100 - _B + (_B * n.astype(np.int64) * documents) // total
    return (10**9 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def _shards(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """The treaps of the asked terms, a row for each shard."""
    release()
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b.column("terms").values)
        if size >= SHARD_POSTINGS:
            yield _shard(held, documents, total)
            held, size = [], 0
    if held:
        yield _shard(held, documents, total)


def _column(held: pa.Table, name: str) -> pa.Array:
    return held.column(name).combine_chunks()


def _shard(held: list[pa.RecordBatch], documents: int, total: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    ids, terms = _column(t, "doc_id"), _column(t, "terms")
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    count = terms.value_lengths().to_numpy()
    term, tf = terms.flatten().to_numpy(), _column(t, "tf").flatten().to_numpy()
    doc, n = np.repeat(place, count), np.repeat(_column(t, "n").to_numpy(), count)
    value = impacts(tf, n, documents, total)
    by = np.lexsort((doc, term))
    term, doc, value = term[by], doc[by], value[by]
    # among equal impacts a scrambled place decides, so copies don't make a chain of the treap
    left, right, roots = _children(term, value << 24 | (doc * 0x9E3779B1 >> 7) & 0xFFFFFF)
    row = {"terms": (term[roots], "<i4"), "roots": (roots, "<i4"), "docs": (doc, "<i4"), "impacts": (value, "<i8"), "below": (left, "<i4"), "above": (right, "<i4")}
    binary = {name: pa.array([x.astype(kind).tobytes()], pa.binary()) for name, (x, kind) in row.items()}
    return pa.RecordBatch.from_pydict({"doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))} | binary)


_SHARD = "doc_ids array<long>, terms binary, roots binary, docs binary, impacts binary, below binary, above binary"


def index(forward: DataFrame, documents: int, total: int) -> DataFrame:
    """The treaps of the terms in (doc_id, n, terms, tf), a row for each shard; it may be written and searched often."""
    return forward.mapInArrow(lambda it: _shards(it, documents, total), _SHARD)


class Best:
    """The best k of each query so far: score descending, then doc_id ascending, null last; unused places have score 0."""

    def __init__(self, queries: int, k: int):
        self.k, self.score = k, np.zeros((queries, k), np.int64)
        self.doc, self.null = np.zeros((queries, k), np.int64), np.zeros((queries, k), bool)

    def least(self, query: np.ndarray) -> np.ndarray:
        """The score that a document needs at least."""
        return np.maximum(self.score[query, -1], 1)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least(query)
        if not good.any():
            return
        of = np.unique(query[good])
        q = np.concatenate((np.repeat(of, self.k), query[good]))
        s, d, z = (np.concatenate((mine[of].ravel(), new[good])) for mine, new in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((d, z, -s, q))
        q, s, d, z = q[order], s[order], d[order], z[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        keep = at < self.k
        where = q[keep], at[keep]
        self.score[where], self.doc[where], self.null[where] = s[keep], d[keep], z[keep]


class Shard:
    """The treaps of one shard, and the walk through them."""

    def __init__(self, row: dict):
        self.doc, self.left, self.right = (np.frombuffer(row[c], "<i4") for c in ("docs", "below", "above"))
        self.value = np.frombuffer(row["impacts"], "<i8")
        self.root = dict(zip(np.frombuffer(row["terms"], "<i4").tolist(), np.frombuffer(row["roots"], "<i4").tolist(), strict=True))
        ids: pa.Array = row["doc_ids"]
        self.ids, self.null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)

    def walk(self, queries: list[tuple[int, list[int]]], weight: np.ndarray, best: Best) -> int:
        """Bring the best of each query (number, terms) up to date; returns how many documents were scored.

        A block of pieces is (query, first document, end, number of subtrees, subtrees, their weights, bound); the root of
        each subtree lies in the piece's interval, what is below it may not."""
        doc, value, blocks, scored, serial = self.doc, self.value, [], 0, 0

        def push(query: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, node: np.ndarray, w: np.ndarray) -> None:
            nonlocal serial
            if len(query):
                bound = np.add.reduceat(value[node] * w, np.cumsum(size) - size)
                if (keep := bound >= best.least(query)).any():
                    inside = np.repeat(keep, size)
                    serial += 1
                    heapq.heappush(blocks, (-int(bound[keep].max()), serial, query[keep], low[keep], high[keep], size[keep], node[inside], w[inside], bound[keep]))

        starts = [(q, [self.root[t] for t in terms if t in self.root], [int(weight[t]) for t in terms if t in self.root]) for q, terms in queries]
        starts = [x for x in starts if x[1]]
        if starts:
            n = len(starts)
            push(np.array([q for q, _, _ in starts]), np.zeros(n, np.int32), np.full(n, len(self.ids), np.int32), np.array([len(r) for _, r, _ in starts]), np.array([x for _, r, _ in starts for x in r], np.int32), np.array([x for _, _, w in starts for x in w], np.int32))
        while blocks:
            taken, n = [], 0
            while blocks and n < _PIECES:
                taken.append(heapq.heappop(blocks)[2:])
                n += len(taken[-1][0])
            query, low, high, size, node, w, bound = (np.concatenate(x) for x in zip(*taken, strict=True))
            now = bound >= best.least(query)
            if now.sum() > _PIECES:  # the highest bounds now, the others go back
                now[np.flatnonzero(now)[np.argsort(-bound[now], kind="stable")[_PIECES:]]] = False
                inside = np.repeat(~now, size)
                push(query[~now], low[~now], high[~now], size[~now], node[inside], w[inside])
            inside = np.repeat(now, size)
            query, low, high, size, node, w = query[now], low[now], high[now], size[now], node[inside], w[inside]
            if not len(query):
                continue
            piece = np.repeat(np.arange(len(query)), size)
            gain = value[node] * w
            greatest = np.flatnonzero(gain == np.maximum.reduceat(gain, np.cumsum(size) - size)[piece])
            split = doc[node[greatest[np.searchsorted(piece[greatest], np.arange(len(query)))]]]
            target = split[piece]
            score, at, here = np.zeros(len(query), np.int64), np.arange(len(node)), node
            while len(at):  # down to the split document in every subtree of its piece
                d, want = doc[here], target[at]
                hit = d == want
                np.add.at(score, piece[at[hit]], value[here[hit]] * w[at[hit]])
                here = np.where(want < d, self.left[here], self.right[here])
                go = ~hit & (here >= 0)
                at, here = at[go], here[go]
            scored += len(query)
            best.add(query, score, self.ids[split], self.null[split])
            for first, end in ((low, split), (split + 1, high)):  # both sides of it
                sub, a, z = node.copy(), first[piece], end[piece]
                move = np.flatnonzero((doc[sub] < a) | (doc[sub] >= z))
                while len(move):  # down to the greatest root inside
                    here = sub[move]
                    sub[move] = here = np.where(doc[here] < a[move], self.right[here], self.left[here])
                    move, here = move[here >= 0], here[here >= 0]
                    move = move[(doc[here] < a[move]) | (doc[here] >= z[move])]
                live = sub >= 0
                left = np.bincount(piece[live], minlength=len(query))
                some = left > 0
                push(query[some], first[some], end[some], left[some], sub[live], w[live])
        return scored


def _found(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """The best k documents of each query among a task's shards."""
    release()
    names, asked, weight = shared.value
    best = Best(len(names), k)
    for b in batches:
        for r in range(b.num_rows):
            shard = Shard({c: b.column(c)[r].as_py() for c in b.schema.names if c != "doc_ids"} | {"doc_ids": b.column("doc_ids").slice(r, 1).flatten()})
            for low in range(0, len(names), _TOGETHER):
                shard.walk([*enumerate(asked)][low : low + _TOGETHER], weight, best)
    query, at = np.nonzero(best.score)
    yield pa.RecordBatch.from_pydict({"item": pa.array([names[q] for q in query.tolist()], pa.string()), "doc_id": pa.array(best.doc[query, at], mask=best.null[query, at]), "score": pa.array(best.score[query, at])})


def weight(documents: int, df: int) -> int:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1)))"""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query, rank from 1."""
    spark = docs.sparkSession
    prepare(spark)
    out = spark.createDataFrame([], "item string, doc_id long, score long")
    for part in _parts(queries, key, text):
        vocabulary = {t: i for i, t in enumerate(sorted({t for own in part.values() for t in own}))}
        rows = texts(docs).mapInArrow(lambda it, s=spark.sparkContext.broadcast(vocabulary): _forward(it, s), "doc_id long, n long, terms array<int>, tf array<int>")
        forward = materialise(rows, "forward")
        documents, total = forward.select(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        df = {r["t"]: r["df"] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # at most MOST_TERMS
        weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(vocabulary))], np.int32)
        asked = spark.sparkContext.broadcast((list(part), [[vocabulary[t] for t in own] for own in part.values()], weights))
        out = out.unionByName(index(forward, documents, total).mapInArrow(lambda it, s=asked: _found(it, s, k), "item string, doc_id long, score long"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(queries.schema[key].dataType).alias("item_id"), "rank", "doc_id", "score")
