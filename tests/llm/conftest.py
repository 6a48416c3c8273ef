"""Awkward tables for the text operators."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, sig string, `__id` string, gram int, spans string, edge double, `__text` string, id string, h string"


def rows_of(texts):
    """Rows (id, text, lang, source, n_chars) with clashing extra columns."""
    return [(i, t, lang, s, None if t is None else len(t), "k", "s", "x", 1, "y", 0.5, "z", "w", "v") for i, t, lang, s in texts]


LONG = " ".join(f"w{i * i % 7919}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank, one-word and long texts, repeated rows and identifiers."""
    body = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest"
    texts = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "word", "en", "a"), (5, body, "en", "a"), (5, body, "en", "a"),
        (6, body + " today", None, None), (7, "same id first", "en", "b"), (7, "same id second and different text", "en", "b"), (None, body + " again", "en", "c"),
        (None, None, None, None), (8, LONG, "en", "a"), (9, "ünï çödé 日本語 🎉 " * 5, "xx", "a"), (10, "a " * 500, "en", "a"),
    ]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
