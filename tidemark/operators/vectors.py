"""Vector search and code resolution: exact top-k by cosine over blocks, without an index and without a cross join.

Queries are a stated set. While they fit MOST_QUERIES they are broadcast, and each task multiplies its Arrow
batches of vectors with all of them, ROWS vectors at a time, keeps the k best it has seen, and gives them once at its
end; more queries run in rounds of that size. So a task holds at most MOST_QUERIES * ROWS scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_QUERIES = 4096
#: Fixed value: vectors that are multiplied with all queries at once.
ROWS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query and group, ties by id."""
    query, own, score, group = rows
    order = np.lexsort((own, -np.round(score, 12), group, query))
    head = np.ones(len(order), bool)
    head[1:] = (query[order[1:]] != query[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return [c[order[place < k]] for c in rows]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query_id, id, score[, by]): the k nearest vectors (id, vector) of each query (query_id, vector), of each `by` if given.

    Ties go to the smaller id."""
    spark = vectors.sparkSession
    out = None
    rows = queries.select("query_id", "vector").where("vector is not null").orderBy("query_id").toLocalIterator()
    part: list = []

    def search(part: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in part], np.int64)
        shared = spark.sparkContext.broadcast((ids, _unit(np.array([r["vector"] for r in part], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query, id, score, group
            for b in batches:
                v = b.column("vector")
                if (np.diff(v.offsets.to_numpy()) != q.shape[1]).any():
                    raise ValueError("vectors of different lengths")
                groups, ids = b.column("grp").to_numpy(), b.column("id").to_numpy()
                flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), q.shape[1])
                for i in range(0, len(ids), ROWS):
                    group, own = groups[i : i + ROWS], ids[i : i + ROWS]
                    s = _unit(flat[i : i + ROWS].astype(np.float64)) @ q.T
                    found = []
                    for g in np.unique(group):
                        at = np.flatnonzero(group == g)
                        part = s if len(at) == len(s) else s[at]
                        least = np.partition(part, len(at) - k, axis=0)[len(at) - k] if len(at) > k else np.full(len(qid), -np.inf)
                        row, col = np.nonzero(part >= least - 1e-11)  # with all that tie for the last place
                        found.append((qid[col], own[at[row]], part[row, col], np.full(len(row), g)))
                    best = _best([np.concatenate(c) for c in zip(best, *found, strict=True)], k)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "id", "score", "grp"])

        source = vectors.select("id", "vector", (F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("grp")).where("vector is not null")
        found = source.mapInArrow(run, "query_id long, id long, score double, grp long")
        w = Window.partitionBy("query_id", *(["grp"] if by else [])).orderBy(F.desc(F.round("score", 12)), "id")
        return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

    for r in rows:
        part.append(r)
        if len(part) == MOST_QUERIES:
            out = search(part) if out is None else out.union(search(part))
            part = []
    if part or out is None:
        if not part:
            return spark.createDataFrame([], "query_id long, id long, score double, grp long")
        out = search(part) if out is None else out.union(search(part))
    return out


def user_search(vectors: DataFrame, owned: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, score) of a user's own codes (id): the k nearest of each query, the best score over the queries."""
    mine = vectors.join(owned.select("id").distinct(), "id", "left_semi")
    return top_k(mine, queries, k).groupBy("id").agg(F.max("score").alias("score"))


def unmapped_search(rows: DataFrame, vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(id, n, score) of names without a code (id a row): how often they occur, and their best score over all queries.

    Queries are broadcast in rounds of MOST_QUERIES, so there may be any number; without any there is no row. A null
    vector is none, one of zeros has score 0; vectors of one table must be equally long."""
    spark = vectors.sparkSession
    n = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    asked = vectors.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).join(n, "id")
    out = None

    def best(part: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(_unit(np.array(part, np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                    top = np.concatenate([(v[k : k + 1024] @ shared.value.T).max(axis=1) for k in range(0, len(v), 1024)])
                    yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), b.column("n"), pa.array(top)], ["id", "n", "score"])

        return asked.mapInArrow(run, "id long, n long, score double")

    part: list = []
    for r in queries.select("vector").where("vector is not null").toLocalIterator():
        part.append(r["vector"])
        if len(part) == MOST_QUERIES:
            out, part = best(part) if out is None else out.unionByName(best(part)), []
    if part:
        out = best(part) if out is None else out.unionByName(best(part))
    if out is None:
        return spark.createDataFrame([], "id long, n long, score double")
    return out.groupBy("id").agg(F.max("n").alias("n"), F.max("score").alias("score")).where(F.col("score") >= least)


def fetch_by_ids(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Count, first and last time of each user's readings of the codes."""
    return rows.where(F.col("fhir_id").isin(ids)).groupBy("user_id", "indicator", "fhir_id").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def merged_rank(hits: DataFrame, floor: float = 0.6) -> DataFrame:
    """Best score of each id over all queries, primary hits and secondary ones above the smallest primary or the floor."""
    best = hits.groupBy("id").agg(F.max("score").alias("score"), F.bool_or("main").alias("main"))
    least = best.agg(F.greatest(F.min(F.when(F.col("main") & (F.col("score") > 0), F.col("score"))), F.lit(floor)).alias("least"))
    return best.join(F.broadcast(least)).where("main or score >= least").select("id", "score", "main")
