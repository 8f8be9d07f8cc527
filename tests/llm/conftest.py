import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASH = ["bucket", "kind", "data", "digit", "key", "keys", "id", "n", "a", "b", "v", "slot", "shard", "rid", "good", "held", "component", "f1", "sig", "kept", "spans", "h1", "walk", "pid"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empties, white space, ties, repeated rows, one very long text, letters of many kinds."""
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
    long = " ".join(words[i * i % 15] + str(i % 97) for i in range(300_000))
    same = " ".join(words * 4)
    return [(1, None), (2, ""), (3, " \t\n"), (4, same), (5, same), (5, same), (6, same + " more"), (7, "two words"), (7, "two words"), (8, "two words"), (9, long), (None, same), (None, None), (10, "12 34 !! ??"), (11, "ÉÀ ß 漢字 🎉 " * 30), (12, "ÉÀ ß 漢字 🎉 " * 30), (13, "x" * 5000), (14, "Two WORDS")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in odd_rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
