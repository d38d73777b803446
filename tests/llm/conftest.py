import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts; ids count from 0 and the source is always the same."""
    def make(texts, lang="en", source="s", first=0):
        return spark.createDataFrame([(first + k, t, lang, source, len(t or "")) for k, t in enumerate(texts)], DOC)

    return make


@pytest.fixture
def odd(spark):
    """Null and empty texts, null ids, repeated rows, ties, a long text, and columns whose names clash with those of the operators."""
    long = " ".join(f"w{k % 997} x{k % 13}" for k in range(60_000))
    texts = [None, "", " \t\n", "one", "one two three four five", "one two three four five", "Ünïcode 漢字 😀 text", "!!! ...", long, long + " end"]
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else "s", 1, "row", "fp", "h", 0, "x", "of", 1.0) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "without an id", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, h string, piece int, u string, of string, score double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOC)
