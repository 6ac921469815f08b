import pytest

from tests.conftest import SF

#: Columns whose names operators use inside, beside those of documents.
EXTRA = "id long, tag int, n int, rest string, bucket int, next string, range int, copy boolean, component_id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a doc_id with two texts, columns with clashing names."""
    long_text = " ".join(f"word{i % 700}" for i in range(20_000))
    texts = [None, "", "   \n\t", "one", "ONE", "one two", "1234 --- 5678", "Ünïcödé ça va, été", "日本語のテキスト です", "a" * 5000, long_text, long_text, "x <|endoftext|> y", "the quick brown fox jumps over the lazy dog " * 30, "the quick brown fox jumps over the lazy dog " * 30]
    rows = [(i, t, None if i % 4 == 0 else "en", "s", None, 1, 2, 3, "r", 4, "n", 5, True, 6) for i, t in enumerate(texts)]
    rows += [rows[5], (5, "another text", "en", None, None, *[None] * 9), (None, "no id here", None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
