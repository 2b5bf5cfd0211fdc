import random

import pytest

from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(words))


def odd_rows():
    """Null, empty, blank, very long and repeated texts; null, repeated and large ids; null metadata."""
    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [
        (1, base, "en", "a", 300),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n ", "de", None, 4),
        (None, prose(rng, 40), "en", "a", 200),
        (5, prose(rng, 9_000) + " " + "x" * 5_000 + " ääö 中文 🙂 e\u0301", "fr", "c", 60_000),
        (6, base, "en", "a", 300),
        (7, base + " more", "en", "a", 305),
        (7, "another text of the same id", "en", "a", 27),
        (8, "one two", "en", "b", 7),
        (2**60, "one two", "en", "b", 7),
        (-5, "don't <|endoftext|> we'll I'VE İstanbul ΣΑΣ \u00a0x", "el", "c", None),
    ]
    return [*rows, rows[0], rows[0], rows[1]]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns named as the operators' own ones."""
    from pyspark.sql import functions as F

    names = ["size", "score", "predicted", "n_tokens", "n_bytes", "over_limit", "rid", "h", "n", "id", "rank", "part", "bucket", "cell", "target", "start", "block", "x", "_n", "item"]
    return odd.select("*", *[F.lit("own").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
