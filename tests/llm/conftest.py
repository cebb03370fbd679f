import random

import pytest

from tidemark.llm.rows import ship

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, `text.h` string, block string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty, long, repeated and non-ASCII texts, and columns named like the operators' own."""
    rng = random.Random(3)
    base = " ".join(rng.choice(["alpha", "beta", "Gamma", "déjà", "x1"]) for _ in range(120))
    rows = [
        (1, "a" * 500, "en", "s1", 500),
        (2, None, None, None, None),
        (3, "", "en", "s1", 0),
        (4, "ab" * 300, "en", None, 600),
        (5, "é" * 200, "fr", "s2", 200),
        (None, base, "en", "s2", None),
        (6, base, "en", "s2", 1),
        (7, base, "en", "s2", 1),
        (7, base, "en", "s2", 1),
        (8, base + " tail", "en", "s3", 1),
        (9, " \n\t ", "en", "s3", 4),
        (10, "one", "en", "", 3),
        (11, "\0" * 250 + "z", "en", "s1", 251),
        (12, " ".join(f"w{k % 997}" for k in range(30_000)), "en", "s1", 1),
        (13, "word" * 40_000, "en", "s9", 1),
    ]
    return spark.createDataFrame([(*r, 5, "h", "b") for r in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
