import random

import pytest

#: Two columns more, with names that operators use for their own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, component string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, ties and repeated rows."""
    long = prose(1, 30_000)
    base = prose(2, 400)
    near = base.rsplit(" ", 1)[0] + " changed"
    rows = [
        (1, base, "en", "a", 1, 1, "x"),
        (2, base, "en", "a", 1, 1, "x"),
        (3, near, "en", "b", 1, 1, "x"),
        (4, long, "fr", "b", 1, 1, "x"),
        (5, "", "fr", None, 0, 1, "x"),
        (6, None, "de", "c", None, None, None),
        (7, " \t\n\x0b ", None, "c", 1, 1, "x"),
        (None, prose(3, 50), "de", "a", 1, 1, "x"),
        (None, None, None, None, None, None, None),
        (8, "\n\nfirst\n\nsecond\nfirst", "en", "a", 1, 1, "x"),
        (9, "Straße 𝄞 é\u0301 \u2003 ok", "de", "a", 1, 1, "x"),
        (10, "one", "de", "a", 1, 1, "x"),
        (11, "12345 678 !!", "de", "a", 1, 1, "x"),
        (12, prose(12, 80), "en", "c", 1, 1, "x"),
        (12, prose(12, 80), "en", "c", 1, 1, "x"),
        (12, prose(13, 80), "en", "c", 1, 1, "x"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
