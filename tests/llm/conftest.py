import pytest

from lintfleet.llm.common import ship

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("da", "fe", "gi", "to", "zu", "pe", "ron")]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as documents with extra columns whose names clash with those of results."""
    ship(spark)

    def make(rows, lang="en"):
        shape = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, label string, node string, piece string"
        return spark.createDataFrame([(i, t, lang, None, None, "x", "x", "x", "x", "x") for i, t in rows], shape)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(WORDS[(i * i) % len(WORDS)] for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one two"), (5, "one two"), (6, long_text), (7, long_text),
            (8, "!!! ???"), (9, "x" * 50_000), (10, "a\x00b ünï 日本語")]
