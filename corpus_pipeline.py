"""The corpus pipeline: documents to token ids, each stage one operator over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
run() writes each stage's result as Parquet to the cluster's shared folder and reads it again.

In every stage other columns stay as they are, whatever their names, an empty table gives an empty one, and texts of
any length are handled whole. What a stage does with nulls, empty texts, ties and repeated rows is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, language, suffix_dedup
from tidemark.llm.common import materialise
from tidemark.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language can't be determined: null and empty texts, and texts without a letter.

    Ties between languages don't matter, as any language is kept; repeated rows are kept or dropped alike; a null lang
    is not learned from. Without any lang that can be learned from, the same documents are dropped."""
    return language.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the smallest doc_id stays.

    Documents without words link with nothing and stay; a row without a doc_id stays; rows that share a doc_id are told
    apart by their texts, and repeated rows of the doc_id that stays all stay."""
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every byte that a repeated string of 200 bytes covers; the documents stay.

    A null text becomes an empty one; no occurrence counts as the first, so repeated rows lose their windows both; a
    character that lost a byte goes whole; n_chars becomes the length of what is left."""
    return suffix_dedup.clean(docs, width=200)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten words in a row of a benchmark item, or all words of a shorter one.

    Null and empty texts have no words and stay; repeated rows are dropped or kept alike."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it: (doc_id, n_tokens, ids, round_trip).

    A null text is empty and has no tokens; of equal merges the leftmost goes first; each row gives a row."""
    return bpe.tokenise(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding)]

#: SQL can't express the merges; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
