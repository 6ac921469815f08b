"""Language identification: known words by their log frequency in each language, unseen ones by character n-grams.

Every word gives evidence for each language: the log of its smoothed frequency there, less the mean over the
languages. A word that the model has not seen backs off to its characters: it is cut into the longest n-grams
that the model knows, from its start on, each step shorter counting less. A text's evidence is its mean over words, taken
for at most EVIDENCE words, so long texts don't become certain of anything. Words are runs of letters.

The model is fitted on a bounded sample: at most about SAMPLE documents of each language that any
row has, chosen by a hash of the doc_id, from the rows whose crc32(doc_id) modulo 3 is not 1. Of each language it
keeps every word and n-gram of the sample, so its size is bounded by the sample alone. The counts are sparse, so the
model grows in proportion to the number of languages, and come to the driver row by row; the evidence for all of them is
worked out for the items of the new chunks of a run of texts.

Defined cases: text that is null or has no letter (digits, numerals, signs) is `und` with score 0; text with letters
that the model knows nothing of gets the most frequent language with the score of a guess; of equally likely languages
the more frequent one, then the first by name is taken; without labelled rows everything is `und`, and keep() drops
only texts that are null or have no letter; texts of any length are read whole, in runs of about 0.5 MB; rows that
share a doc_id, and repeated rows, each give a row; a null doc_id is never learned from; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .chunks import ChunkTable, Matrix, row_sums
from .common import fold, prepare, worker_state

SAMPLE, LONGEST, EVIDENCE = 2_000, 4, 25
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}+")
#: Numbers of a dense block of evidence.
_BLOCK = 1 << 18


class Counts:
    """Items by language, sparse. Items of one kind share the languages' totals: all words are one kind, and n-grams of
    a length are (by_length)."""

    def __init__(self, counts: dict[str, dict[str, int]], languages: list[str], by_length: bool):
        at = {lang: i for i, lang in enumerate(languages)}
        self.row = {item: i for i, item in enumerate(counts)}
        self.kind = np.array([len(item) if by_length else 0 for item in counts], np.int8)
        size = np.array([len(x) for x in counts.values()], np.int64)
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.lang = np.array([at[lang] for x in counts.values() for lang in x], np.int32)
        n = np.array([c for x in counts.values() for c in x.values()], np.float64)
        kinds = LONGEST + 1
        total = np.zeros((kinds, len(languages)))
        np.add.at(total, (np.repeat(self.kind, size), self.lang), n)
        total += 0.3 * np.bincount(self.kind, minlength=kinds)[:, None]
        self.log_total = np.log(np.maximum(total, 1e-300))
        self.log_count = np.log(n + 0.3)

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        """Log frequencies of items in each language less their mean, within 6."""
        size = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        v = np.full((len(rows), self.log_total.shape[1]), np.log(0.3))
        v[np.repeat(np.arange(len(rows)), size), self.lang[at]] = self.log_count[at]
        v -= self.log_total[self.kind[rows]]
        return np.clip(v - v.mean(axis=1, keepdims=True), -6, 6)


class Model:
    """Evidence of words and n-grams; languages in order of their frequency."""

    def __init__(self, languages: list[str], words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        self.languages, self.name = languages, uuid.uuid4().hex
        self.words, self.grams = Counts(words, languages, False), Counts(grams, languages, True)

    def _cut(self, w: str) -> list[tuple[int, float]]:
        """The longest known n-grams of a word, from its start on, with their weights."""
        s, find, i, out = f"^{w}$", self.grams.row.get, 0, []
        n = len(s)
        while i < n:
            weight = 1.0
            for k in range(min(LONGEST, n - i), 0, -1):
                if (row := find(s[i : i + k])) is not None:
                    out.append((row, weight))
                    break
                weight *= 0.6
            i += k
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """The evidence of each word, by its own counts or those of its n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        step = max(1, _BLOCK // max(1, len(self.languages)))
        for low in range(0, len(words), step):
            part = words[low : low + step]
            rows = np.array([self.words.row.get(w, -1) for w in part], np.int64)
            known = np.flatnonzero(rows >= 0)
            out[low + known] = self.words.evidence(rows[known])
            pieces = [(i, *p) for i in np.flatnonzero(rows < 0).tolist() for p in self._cut(part[i])]
            if pieces:
                owner, found, weight = (np.array(x) for x in zip(*pieces, strict=True))
                v = np.zeros((len(part), len(self.languages)))
                np.add.at(v, owner, self.grams.evidence(found) * weight[:, None])
                n = np.bincount(owner, minlength=len(part))
                cut = np.flatnonzero(n)
                out[low + cut] = np.clip(2 * v[cut] / n[cut, None], -6, 6)
        return out

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray]:
        """Of each chunk the sum of its words' evidence, and their number."""
        found = [_WORD.findall(c.lower()) for c in chunks]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for x in found for w in x))}
        evidence = self.evidence(list(distinct))
        out = np.zeros((len(chunks), len(self.languages) + 1))
        owner = np.repeat(np.arange(len(chunks)), [len(x) for x in found])
        np.add.at(out[:, :-1], owner, evidence[[distinct[w] for x in found for w in x]])
        out[:, -1] = np.bincount(owner, minlength=len(chunks))
        return (out,)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the labelled rows of docs (doc_id, text, lang) that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return Model([], {}, {})
    share = docs.sparkSession.createDataFrame([(r["lang"], sample / r["count"]) for r in found], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    words = words.persist()
    marked = words.select("lang", "n", F.concat(F.lit("^"), F.col("item"), F.lit("$")).alias("w"))
    cuts = F.flatten(F.array(*[F.expr(f"transform(sequence(1, greatest(1, length(w) - {k - 1})), i -> substring(w, i, {k}))") for k in range(1, LONGEST + 1)]))
    grams = marked.select("lang", "n", F.explode(cuts).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n"))

    def by_item(counts: DataFrame) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for r in counts.select("item", "lang", "n").toLocalIterator():
            out.setdefault(r["item"], {})[r["lang"]] = r["n"]
        return out

    model = Model([r["lang"] for r in found], by_item(words), by_item(grams))
    words.unpersist()
    return model


def _guesses(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    n, pred, score = len(model.languages), [], []
    table = worker_state(("language", model.name), lambda: ChunkTable(model.chunks, Matrix(n + 1)))
    for _, _, raw, ends in textops.slices(column, textops.SHORT_RUN):
        v = row_sums(table, raw, ends)
        count = np.maximum(v[:, n], 1)
        e = v[:, :n] * (np.minimum(count, EVIDENCE) / count)[:, None]
        if n:
            p = np.exp(e - e.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            sure = p[np.arange(len(p)), best] / p.sum(axis=1)
        else:
            best, sure = np.zeros(len(v), np.int64), np.zeros(len(v))
        letters = v[:, n] > 0
        pred += [model.languages[k] if known and n else UNDETERMINED for k, known in zip(best.tolist(), letters.tolist(), strict=True)]
        score.append(np.where(letters, sure, 0.0))
    return pred, np.concatenate(score) if score else np.zeros(0)


def _predicted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pred, score = _guesses(b.column("text"), shared.value)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def _kept(batches: Iterator[pa.RecordBatch], shared, least: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for b in batches:
        text = b.column("text").cast(pa.large_string())
        if model.languages:
            pred, score = _guesses(text, model)
            yield b.filter(pa.array([p != UNDETERMINED and s >= least for p, s in zip(pred, score.tolist(), strict=True)], pa.bool_()))
        else:
            yield b.filter(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of docs, by a model fitted on docs if none is given."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id").cast("long")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: _predicted(it, shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None = None, least: float = 0.0) -> DataFrame:
    """The rows of docs whose language is determined, with a score of at least `least`; all columns as they are.

    By default that drops texts that are null or have no letter, and no others; `least` is the evidence, the
    probability of the best language, below which a model drops more. Without a model `least` has no effect."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return docs.mapInArrow(lambda it: _kept(it, shared, least), docs.schema)
