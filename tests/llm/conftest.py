import pytest
from pyspark.sql import functions as F


@pytest.fixture
def texts(spark):
    """Documents of the usual columns from (id, text) pairs, with columns whose names operators use themselves."""

    def of(pairs):
        df = spark.createDataFrame(list(pairs), "doc_id long, text string")
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n": F.lit(1), "key": F.lit("k"), "node": F.lit(2), "words": F.lit("w"), "row_": F.lit(0), "spans": F.lit(0)})

    return of


@pytest.fixture
def awkward():
    """Null and empty texts, white space only, a null id, repeated rows, and a very long text."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, long), (6, "x" * 20_000), (7, "é ü 中文 😀 ﬁ"), (8, "one")]
