import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = ["", None, " ", "one", "\n\n\n", "é" * 50_000, "word " * 4_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, equal ids with other texts, clashing extra columns."""
    rows = [(k, t) for k, t in enumerate(BLANKS)] + [(3, "one"), (3, "another text"), (None, "no id"), (None, None), (50, "word " * 4_000)]
    extra = "block int, key string, hits string, label int, h1 string, pos int, part string, file string, template string, shard int"
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], COLUMNS)
    for column in extra.split(", "):
        name, kind = column.split()
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
