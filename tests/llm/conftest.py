import pytest
from pyspark.sql import types as T

#: Columns that the operators use inside, and that a table may hold as well.
CLASHING = ["n_words", "size", "kept", "score", "label", "component_id", "rep", "key", "cell", "rank", "h", "doc",
            "stratum", "base_failed", "held_out", "apart", "part", "ids", "set_id", "_dropped", "_words", "_flat"]


@pytest.fixture
def make_docs(spark):
    """documents rows from (doc_id, text[, lang]); with ``extra``, also columns of clashing names."""
    def build(rows, extra=False):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                  T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        if extra:
            fields += [T.StructField(c, T.StringType()) for c in CLASHING]
        data = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *(["x"] * len(CLASHING) if extra else []))
                for r in rows]
        return spark.createDataFrame(data, T.StructType(fields))
    return build


@pytest.fixture
def make_labels(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null text, empty, blank, repeated rows, equal texts, other scripts, one very long text."""
    long_text = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))
    return [(None, "a row without an id"), (1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (4, "one two three"),
            (5, "one two three"), (6, "naïve café ÜBER ☃ 日本語 😀\r\nline\x0btwo"), (7, long_text), (8, long_text + " end"),
            (9, "<s></s><unk> ▁ <|endoftext|>"), (10, "the quick brown fox jumps over the lazy dog " * 3)]
