import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names the
    operators use themselves."""
    long = " ".join(f"word{i % 7919}" for i in range(60_000))
    same = "one two three four five six seven eight nine ten eleven twelve " * 50
    rows = [(1, "the cat sat on the mat and the dog ran away", "en", "a"), (2, None, None, None), (None, "orphan text with no id", "en", "a"),
            (3, "", "en", "b"), (4, "  \n\t ", "fr", "b"), (5, "12345 !!! ...", "fr", "c"), (6, long, "en", None),
            (7, same, "en", "a"), (8, same, "en", "a"), (9, same.upper(), "en", "b"), (10, "é", "fr", "c"), (10, "é", "fr", "c"),
            (None, None, "de", "c"), (1 << 60, "the cat sat on the mat and the dog ran away", None, "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept string, hits string, target string"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", "z", "h", "t") for r in rows], schema)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with more names that operators use inside, each with the row's own value."""
    from pyspark.sql import functions as F
    return odd.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c)
                             for c in ("key", "_key", "_text", "row", "_hits", "hits_", "cut", "word", "part", "n")])


@pytest.fixture(scope="session")
def docs(spark):
    from keepsake.llm.common import session
    return session(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
