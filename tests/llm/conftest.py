import pytest

EXTRA = "kept int, n int, w string, row string"


@pytest.fixture
def messy(spark):
    """A documents table with nulls, an empty and a very long text, repeated rows, shared ids, and clashing extra columns."""
    long_text = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (4, "another text under the same id"),
            (5, long_text), (6, long_text), (None, "no id here at all"), (7, "É é 日本 😀\x00 <|endoftext|> 'll   x")]
    return spark.createDataFrame([(*r, 1, 2, "w", "r") for r in rows], f"doc_id long, text string, {EXTRA}")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")
