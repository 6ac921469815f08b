"""Corpus operators must do the whole job where a group, a vocabulary or a run of text is large."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.test_text_operators import brute_dedup, overlapping, sorted_rows
from tidemark.llm import bpe, chunks, common, fingerprint, language, suffix_dedup
from tidemark.llm.queries import tokenizer

CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def footers(n):
    """One line of 180 bytes between different neighbours; in some documents the neighbours are the same."""
    r = random.Random(3)
    line = "".join(r.choice("abcdefgh ") for _ in range(180))
    near = lambda: "".join(r.choice("ijklmnop") for _ in range(150))
    a, b = near(), near()
    return [(i, (a if i % 7 == 0 else near()) + line + (b if i % 5 == 0 else near())) for i in range(n)]


@pytest.mark.parametrize("hot", [1, 2, 5])
def test_suffix_dedup_deals_out_the_windows_of_hot_grams(spark, hot):
    data = [*footers(60), *[(i + 100, t) for i, t in overlapping() if i is not None]]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted_rows(suffix_dedup.dedup(df, 200, hot=hot), *CUT) == brute_dedup(data, 200)


def test_suffix_dedup_groups_stay_small():
    """However many documents hold a line, its gram's bucket gets no more postings, and no text goes to one group."""
    def most(n):
        b = pa.record_batch({"id": pa.array(range(n), pa.int64()), "tag": pa.array([0] * n, pa.int32()), "text": pa.array([t for _, t in footers(n)])})
        sent = pa.Table.from_batches(list(suffix_dedup._chunk_postings(iter([b]), 200, 1, 16)))
        return np.unique(suffix_dedup._joined(sent, 0)["gram"], return_counts=True)[1].max()

    assert most(400) <= 16 and most(40) <= 16


def test_suffix_dedup_first_pass_hands_on_without_copies():
    """Beside the postings that a task holds there is never a second copy of all of them, once they are handed on."""
    r = np.random.RandomState(4)
    texts = ["".join(map(chr, r.randint(97, 123, 4000))) for _ in range(2500)]
    b = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "tag": pa.array([0] * len(texts), pa.int32()), "text": pa.array(texts)})
    tracemalloc.start()
    try:
        sent = sum(len(x) for part in suffix_dedup._chunk_postings(iter([b]), 200, 64) for x in part.column("postings").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent > 6 << 20 and peak < 30 << 20


def traced(work):
    """The most bytes that work() holds at a time beyond those before it, and what it gives."""
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_chunk_tables_are_halved_in_place():
    """What is kept is moved some at a time: the positions of all of it would take eight times its bytes, more than once."""
    table, r = chunks.Ragged(np.uint8), np.random.RandomState(6)
    size = r.randint(0, 2000, 16_000)
    flat = r.randint(0, 256, size.sum()).astype(np.uint8)
    table.add(flat, size)
    rows = np.flatnonzero(r.rand(len(size)) < 0.5)
    peak, _ = traced(lambda: table.keep(rows))
    end = np.cumsum(size)
    assert table.rows == len(rows) and table.used == size[rows].sum()
    assert all(np.array_equal(table.take(np.array([k]))[0], flat[end[i] - size[i] : end[i]]) for k, i in enumerate(rows))
    table.add(flat[:5], np.array([2, 3]))
    assert np.array_equal(table.take(np.array([table.rows - 1, 0]))[0], np.concatenate((flat[2:5], flat[end[rows[0]] - size[rows[0]] : end[rows[0]]])))
    assert peak < 16 << 20


def test_encoders_hold_little_beside_their_vocabulary():
    """Both while they meet new words and while they go through long batches of known ones."""
    r, path = random.Random(7), tokenizer("byte_bpe_50k.json")
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9)))
    new = pa.array([" ".join(word() for _ in range(300)) for _ in range(200)])
    known = pa.array(["the cat sat on the mat and saw the dog " * 50] * 2000)
    common.release()
    bpe.encoder(path)
    for texts, most in ((new, 60), (known, 60)):
        b = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
        peak, n = traced(lambda b=b: sum(sum(x.column("round_trip").to_pylist()) for x in bpe._tokenised(iter([b]), path)))
        assert n == len(texts) and peak < most << 20, (peak >> 20, most)


def test_a_worker_gives_arrows_memory_back(monkeypatch):
    """Also if no operator has left a state in the worker."""
    freed = []
    pool = type("Pool", (), {"release_unused": lambda self: freed.append(1)})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    monkeypatch.setattr(common, "_state", [None, None])
    common.release()
    assert freed


def test_tables_of_steps_have_small_row_groups(spark):
    """A task holds a row group as it writes or reads, so it must not grow with the task's rows."""
    rows = spark.range(0, 6_000_000, 1, 1).selectExpr("id", "xxhash64(id) as a", "xxhash64(id, 1) as b")
    files = [pq.ParquetFile(f) for f in common.materialise(rows, "groups").inputFiles() for f in [f.removeprefix("file://")]]
    assert max(m.row_group(i).total_byte_size for m in (f.metadata for f in files) for i in range(m.num_row_groups)) < 2 * common.ROW_GROUP


def test_every_language_is_learned(spark):
    """More languages than the 64 that were learned once; each has words of its own."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    words = {f"l{k:02}": [word() for _ in range(6)] for k in range(80)}
    rows = [(i, " ".join(r.choices(words[lang], k=12)), lang) for i, lang in enumerate(sorted(words) * 12)]
    got = {p["doc_id"]: p["lang_pred"] for p in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i, _, _ in rows] == [lang for _, _, lang in rows]


def test_every_word_of_the_sample_is_learned(spark):
    """More words than were kept once, each of them once, in languages that share their n-grams."""
    r = random.Random(7)
    words = [*{"".join(r.choices("abcdefgh", k=9)) for _ in range(50_000)}]
    half = len(words) // 2
    rows = [(i, " ".join(words[a : a + 500]), lang) for i, (a, lang) in enumerate((a, lang) for lang, low, high in (("x", 0, half), ("y", half, len(words))) for a in range(low, high, 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {w: lang for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1 for w in t.split()}
    model = language.fit(df)
    assert set(model.words.row) == set(learned) and len(learned) > 25_000
    asked = r.sample(sorted(learned), 300)
    got = {p["doc_id"]: p["lang_pred"] for p in language.predict(spark.createDataFrame([*enumerate(asked)], "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(300)] == [learned[w] for w in asked]


def test_without_labels_only_texts_without_letters_go(spark):
    rows = [(1, "some text", None), (2, "123 --", None), (3, None, None), (4, "日本", None)]
    kept = language.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 4]


def test_order_minhash_of_unspaced_text(spark):
    r = random.Random(6)
    rows = [(x, "新" + x, x[:300] + "y" + x[300:], "".join(r.choices("いろは", k=900))) for x in ("".join(r.choices("天地玄黄宇宙洪荒😀日月", k=900)), "".join(r.choices("abcdef=/", k=900)))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    for c in "abcd":
        df = fingerprint.add_fingerprint(df, c, f"f{c}")
    for x in df.select(*[fingerprint.likeness("fa", f"f{c}").alias(c) for c in "bcd"]).collect():
        assert x["b"] > 0.8 and x["c"] > 0.6 and x["d"] < 0.1
