import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, terms string, gone string, row long, score double"


@pytest.fixture(scope="session")
def make(spark):
    """A table like ``documents`` from (doc_id, text, lang, source), with further columns whose names clash."""

    def of(rows, parts=3):
        full = [(i, t, lang, s, len(t) if t is not None else None, 1, "t", "g", 5, 0.5) for i, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and blank texts, a very long word and text, repeated rows."""
    long_text = " ".join(f"w{k % 977}x" for k in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "x" * 50_000, None, "a"), (5, long_text, "en", "b"),
        (6, "one two", "en", "b"), (7, "same words in this row here", "en", "b"), (7, "same words in this row here", "en", "b"),
        (None, "same words in this row here", "en", "b"), (8, "One TWO", "de", "\U0001f600"), (9, "é\x85ü <|endoftext|> 12 !!", "fr", "a"),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def nothing(make):
    return make([(1, "a", "en", "s")]).where("doc_id is null")
