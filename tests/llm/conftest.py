import random

import pytest

WORDS = "the of and river stone market window garden yellow purple engine letter mountain signal paper winter summer orchard lantern harbour".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): plain and odd cases in one small table."""
    rng = random.Random(3)
    base = prose(rng, 60)
    edited = base.replace(base.split()[30], "changed", 1)
    found = [(k, prose(rng, rng.randint(30, 90)), "en") for k in range(10, 30)]
    return [
        *found, (1, base, "en"), (2, base, "en"), (3, edited, None), (4, None, "en"), (5, "", None), (6, " \t\n\x0b\f\r", "de"),
        (7, "one", "en"), (8, "Ünï çödé ß \U0001d54f text " * 5, "de"), (9, prose(rng, 6000), "en"), (9, prose(rng, 40), "en"),
        (None, "an id that is null stays a row of its own kind here", "en"), (31, "x" * 5000, "en"), (32, "1 " * 3000, None), (1, base, "en"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The table with columns whose names clash with results."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("clash"), "shard": F.lit(-1), "fingerprint": F.lit("f"), "length": F.lit(1)}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
