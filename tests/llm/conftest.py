import pytest
from pyspark.sql import types as T

LONG = "word " * 30_000 + "x" * 50_000 + " 1" * 5_000 + "@" * 1_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),   # repeated row
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),   # copy, tie
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n ", "", ""),
    (6, LONG, "en", "a"),
    (7, "Écrivez à jean.dupont@mail.example.com ou +33 (1) 5555-1234, carte 4111 1111 1111 1111, hôte 10.0.0.255.", "fr", "c.d"),
    (8, "ein kurzer Satz auf Deutsch und noch ein Wort dazu für die Probe", "de", "c.d"),
    (None, "a row without an id", "en", "a"),
    (9, "!!! ??? 123", "en", None),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
#: Names that operators use inside.
CLASHING = ("id", "t", "fp", "low", "root", "w", "n", "key", "block", "tokens", "share", "host", "best", "lp", "items", "a", "b", "c", "s", "e", "row")


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"clash-{c}").alias(c) for c in CLASHING], F.lit(None).cast("string").alias("n_chars"))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    return with_clashes(spark.createDataFrame(TEXTS, SCHEMA).repartition(3))


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))
