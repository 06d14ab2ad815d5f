import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(1, "a plain text of some words"), (2, None), (None, "no id here"), (3, ""), (3, ""), (4, "x" * 70_000), (5, "a plain text of some words"), (5, "a plain text of some words"), (6, "Ünï çödé \U0001f600 \t\r\n  end  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("id", "cls", "h", "row", "token", "score", "n", "spans")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
