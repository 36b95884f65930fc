import pytest

#: Column names that the operators use inside, as extra columns of the input.
CLASHING = ["fp", "stratum", "kept", "task", "rank", "length", "place", "slot", "position", "chunk", "gram", "ids", "rest",
            "found", "part", "turns", "n_words", "shard", "component_id", "score", "sequence_id", "offset"]

PROSE = ("the thing and the other are in that place with an old stone house by the river where nobody has been for a "
         "long time because it was far from every road and the people said it was cold in there all year round so they "
         "left it alone and went on to the next town which had a market and a school and many more warm rooms to live")


def messy_rows():
    """Nulls, empty texts, ties, repeated rows and a very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE + " today", "en"), (4, None, "en"), (5, "", None), (6, "   \n\t", "fr"),
            (7, "word", "de"), (8, long_text, "xx-long-code"), (None, "no id " + PROSE, None), (None, None, None),
            (9, "A!! B!! ### $$$ %% A!! B!! ###", "en"), (10, "línea única\nlínea única\n", "es")]
    return rows + rows[:1] + rows[3:4]  # repeated rows


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(messy_rows(), "doc_id long, text string, lang string").repartition(3)
    df = df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """Real rows: the documents of the smallest test data."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
