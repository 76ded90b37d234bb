import duckdb
import pytest

#: Columns that the operators use inside under the same names.
CLASHING = ["body", "row_no", "tid", "text64", "key", "key64", "size", "bucket", "shard", "slot", "owner", "words", "name", "digest", "place", "grp", "score", "label", "y"]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        full = [(i, t, g, s, None if t is None else len(t), *("x" for _ in CLASHING)) for i, t, g, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"w{i % 977}{chr(97 + i % 23)}" for i in range(20_000))
    base = " ".join(f"base{i}" for i in range(60))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "fr", "b"),
        (5, words, "en", "b"), (6, words + "\n", "en", "a"), (7, "one two", "en", None), (8, "one  two", "fr", "c"),
        (9, base, "de", "c"), (10, base + " tail", "de", "c"), (10, base + " tail", "de", "c"), (10, base + " tail", "de", "c"),
        (None, base, "de", None), (None, None, None, None), (None, "other text of a row without id", "en", "a"),
        (11, "!!! 123 ###", "en", "a"), (12, "Straße über Ärger — 日本語 😀 <|endoftext|> it's", "de", "b"), (-5, base.upper(), "de", "b"),
    ]


@pytest.fixture(scope="session")
def odd(docs_of, odd_rows):
    return docs_of(odd_rows)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def given(small):
    """(doc_id, text) of the smallest given documents."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def given_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
