import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket int, k1 string, kept string, place string, members string, rid string, host string, key string"


def prose(rng: random.Random, n: int, vocabulary: int = 400, mark: str = "w") -> str:
    return " ".join(f"{mark}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "changed"
    passage = prose(rng, 70, 5000, "p")
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"), (4, prose(rng, 150), "de", "a"), (5, "", "en", "a"), (6, None, "en", None), (None, prose(rng, 60), None, "b"),
        (8, prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 30), "en", "c"), (9, passage + " " + prose(rng, 90), "de", "c"), (10, "one two", "en", "a"), (10, "one two", "en", "a"),
        (11, " \t\n ", "en", "b"), (12, prose(rng, 9000), "en", "a"), (13, "x " * 3000, "en", "b"), (14, "ÄÖ ☃ é\r\n" + prose(rng, 55), "de", None), (15, prose(rng, 3) + " " + prose(rng, 60), None, "c"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, lang, s, None if t is None else len(t), 1, 2, "x", "y", None, "m", "r", "h", "k") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
