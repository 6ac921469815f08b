"""Toxicity: two Kneser-Ney models of words as character sequences, one of toxic and one of ordinary text.

A document's evidence is the log-likelihood of its words under the toxic model less that under the ordinary
one, taken a word on average, so length does not count. Toxic text consists of ordinary words for the most
part, so the toxic model is a mixture of both classes. Both models interpolate: a class's own counts of
character n-grams of the highest order, absolutely discounted, rest on backoff distributions by continuation
counts, which both classes share. A rare expression that neither class has seen so gets equal likelihoods,
and inflected or misspelt forms of a known one still meet its n-grams.

The models are fitted on a bounded sample: at most about SAMPLE labelled documents of each class, chosen by a
hash of the doc_id, from the rows whose crc32(doc_id) modulo 3 is not 1. FIT percent of them give the counts, of
all their words, the others the logistic curve that turns evidence into a score from 0 to 1.

Scoring needs the ratio of the two models only. Of an n-gram that neither class has, both step down to the same
shared distribution, so the ratio depends on the characters before the last one alone. So the tasks get two sorted
arrays: the log ratio of each n-gram of the sample, and of each beginning of one.

Defined cases: null and empty texts have no evidence and get the score of the curve there; without labels of
both classes every score is the share of toxic labels (0 without labels); labels that are null are ignored;
a doc_id with several labels is toxic if one says so; scores of the threshold itself count as toxic; rows that share
a doc_id, and repeated rows, each give a row; texts of any length are read whole, in runs of about 2 MB; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .chunks import ChunkTable, Matrix, row_sums
from .common import fold, materialise, prepare, worker_state

SAMPLE, FIT, ORDER, DISCOUNT, THRESHOLD = 2_000, 70, 6, 0.75, 0.7
#: The toxic model takes so large a part of its words from its own counts, the rest as ordinary text does.
SHARE = 0.02
_WORD = regex.compile(r"[\p{L}\p{N}_]+")


class KneserNey:
    """Log-likelihood ratios of words from counts of words in each class: {word: (ordinary, toxic)}."""

    def __init__(self, words: dict[str, tuple[float, float]], order: int = ORDER):
        self.order = order
        own: tuple[dict, dict] = (defaultdict(float), defaultdict(float))
        total: tuple[dict, dict] = (defaultdict(float), defaultdict(float))
        kinds: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
        types: set[str] = set()
        for w, count in words.items():
            s = f"^{w}$"
            for i in range(1, len(s)):
                g = s[max(0, i + 1 - order) : i + 1]
                types.add(g)
                for c in (0, 1):
                    if count[c]:
                        kinds[c][g[:-1]] += g not in own[c]
                        own[c][g] += count[c]
                        total[c][g[:-1]] += count[c]
        # shared: how many different characters stand before an n-gram, in both classes together
        self.before: dict[str, int] = defaultdict(int)
        self.before_total: dict[str, int] = defaultdict(int)
        self.before_kinds: dict[str, int] = defaultdict(int)
        by_length: list[set[str]] = [{g for g in types if len(g) == k} for k in range(order + 1)]
        for k in range(order, 1, -1):  # long ones first: what stands before a shorter one counts once
            for g in by_length[k]:
                self.before[g[1:]] += 1
                by_length[k - 1].add(g[1:])
        for r, n in self.before.items():
            self.before_total[r[:-1]] += n
            self.before_kinds[r[:-1]] += 1
        self.own, self.total, self.kinds = [dict(x) for x in own], [dict(x) for x in total], [dict(x) for x in kinds]
        self.before, self.before_total, self.before_kinds = dict(self.before), dict(self.before_total), dict(self.before_kinds)
        self.floor = 1 / 256

    def shared(self, h: str, x: str) -> float:
        n = self.before_total.get(h)
        if not n:
            return self.shared(h[1:], x) if h else self.floor
        lower = self.shared(h[1:], x) if h else self.floor
        return (max(self.before.get(h + x, 0) - DISCOUNT, 0) + DISCOUNT * self.before_kinds[h] * lower) / n

    def _step(self, g: str) -> float:
        """Log of the toxic to the ordinary probability of the last character after the others."""
        h, x = g[:-1], g[-1]
        lower = self.shared(h[1:], x)
        p = [(max(self.own[c].get(g, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[c][h] * lower) / n if (n := self.total[c].get(h)) else lower for c in (0, 1)]
        return math.log(p[1] / p[0])

    def _context(self, h: str) -> float:
        """The same of an n-gram that neither class has: what each class leaves to the shared distribution after h."""
        left = [DISCOUNT * self.kinds[c][h] / n if (n := self.total[c].get(h)) else 1.0 for c in (0, 1)]
        return math.log(left[1] / left[0])

    def tables(self) -> tuple[dict[str, float], dict[str, float]]:
        """Log ratios of the n-grams that a class has, and of the beginnings of others."""
        return {g: self._step(g) for g in self.own[0] | self.own[1]}, {h: self._context(h) for h in self.total[0] | self.total[1]}


def _gram_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of code points."""
    return textops.span_hashes(textops.value_sums(textops.mix(codes.astype(np.uint64) + np.uint64(1))), start, end)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with their borders marked, one after the other, and where each ends."""
    marked = [f"^{w}$" for w in words]
    return np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(w) for w in marked], dtype=np.int64)


class Ratios:
    """Log-likelihood ratios of words under the toxic mixture and the ordinary model."""

    def __init__(self, words: dict[str, tuple[float, float]], order: int = ORDER):
        self.order = order
        self.grams, self.contexts = map(self._sorted, KneserNey(words, order).tables())

    @staticmethod
    def _sorted(table: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(table).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum([len(g) for g in table], dtype=np.int64)
        keys = _gram_hashes(codes, np.concatenate(([0], end[:-1])) if len(end) else end, end)
        order = np.argsort(keys)
        return keys[order], np.fromiter(table.values(), np.float32, len(table))[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(table[0]):
            return np.zeros(len(keys)) + other
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], other)

    def of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        codes, end = _codes(words)
        begin = np.concatenate(([0], end[:-1]))
        word = np.repeat(np.arange(len(words)), end - begin)
        last = np.arange(len(codes))
        first = np.maximum(last + 1 - self.order, begin[word])
        on = last > begin[word]  # a step for each character after the first
        sums = textops.value_sums(textops.mix(codes.astype(np.uint64) + np.uint64(1)))
        first, last, word = first[on], last[on], word[on]
        v = self._find(self.grams, textops.span_hashes(sums, first, last + 1), self._find(self.contexts, textops.span_hashes(sums, first, last), 0.0))
        out = np.bincount(word, v, len(words))
        return np.log1p(SHARE * np.expm1(np.minimum(out, 300.0)))

    def ratio(self, word: str) -> float:
        return float(self.of([word])[0])


class Model:
    def __init__(self, ratios: Ratios | None, slope: float, offset: float):
        self.ratios, self.slope, self.offset, self.name = ratios, slope, offset, uuid.uuid4().hex

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray]:
        """Of each chunk the sum of its words' log ratios, and their number."""
        found = [_WORD.findall(c.lower()) for c in chunks]
        owner = np.repeat(np.arange(len(chunks)), [len(x) for x in found])
        v = self.ratios.of([w for x in found for w in x]) if self.ratios else np.zeros(len(owner))
        return (np.stack((np.bincount(owner, v, len(chunks)), np.bincount(owner, minlength=len(chunks))), axis=1),)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """The mean log ratio of each text's words."""
        table = worker_state(("toxicity", self.name), lambda: ChunkTable(self.chunks, Matrix(2)))
        sums = np.concatenate([np.zeros((0, 2)), *(row_sums(table, raw, ends) for _, _, raw, ends in textops.slices(column))])
        return sums[:, 0] / np.maximum(sums[:, 1], 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -500, 500)))


def _evidence(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(shared.value.evidence(b.column("text")), pa.float64())], ["toxic", "evidence"])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression with a weak pull to zero, by Newton's method."""
    scale = x.std() or 1.0
    a = np.stack((x / scale, np.ones(len(x))), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.02, 1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([0.02, 0]) * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the labelled rows of docs (doc_id, text) that are not held out; labels (doc_id, toxic)."""
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(None, 0.0, 40.0 if 1 in n else -40.0)
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = marks.where(luck < F.when(F.col("toxic") == 1, sample / n[1]).otherwise(sample / n[0]) * 1_000_003)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # the sample is bounded by its parameter, so its ids may be broadcast
    rows = materialise(rows.join(F.broadcast(chosen), "doc_id"), "labelled")
    counting = F.pmod(F.hash("doc_id", F.lit("counts")), F.lit(100)) < FIT
    counts = rows.where(counting).select("toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count_if(F.col("toxic") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b"))
    ratios = Ratios({r["w"]: (r["a"], r["b"]) for r in counts.toLocalIterator()})
    shared = spark.sparkContext.broadcast(Model(ratios, 0, 0))
    seen = rows.where(~counting).select("toxic", "text").mapInArrow(lambda it: _evidence(it, shared), "toxic int, evidence double").collect()
    shared.unpersist()
    x, y = np.array([r["evidence"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    if len(set(y)) < 2:
        return Model(ratios, 0.0, math.log(n[1] / n[0]))
    slope, offset = _curve(x, y)
    # the sample takes the classes evenly; the curve's offset goes back to their shares
    drawn = (y.sum() / len(y)) / (1 - y.mean())
    return Model(ratios, slope, offset + math.log(n[1] / n[0]) - math.log(drawn))


def _scored(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for b in batches:
        s = model.score(model.evidence(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs, by a model fitted on labels if none is given."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs, labels))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id").cast("long")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: _scored(it, shared, threshold), "doc_id long, held_out boolean, score double, predicted int")
