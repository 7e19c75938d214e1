import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with nulls, blanks, ties, repeats, a long text and clashing column names."""

    def make(rows=None, extra=True):
        if rows is None:
            base = "the quick brown fox jumps over the lazy dog while seven clever otters build a small wooden raft near the old mill at dawn"
            rows = [
                (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n", None, None), (3, base, "en", "a"), (4, base.upper(), "en", "b"), (5, base.replace(" ", "  "), "de", "b"),
                (6, base + " again", "de", "a"), (7, base, "en", None), (8, "one two", "en", "c"), (9, "One\tTWO", "en", "c"), (10, "x" * 5000 + " " + "ab " * 3000, "fr", "c"),
                (11, "Released under the MIT License.\n" + base, "en", "a"), (11, "Released under the MIT License.\n" + base, "en", "a"), (None, "no identifier here at all", "en", "a"), (12, "é中😀 <|endoftext|> naïve 12", "fr", "b"),
            ]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("digest", "size", "kept", "n", "word", "band", "set", "stratum", "class", "part"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
