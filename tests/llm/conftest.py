import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, x int, score double, part int, bands string"


def prose(rng, n):
    parts = "the of and an er on th re in ha at en st ou nd ti es ing ble tion".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(texts, first=0):
    return [(first + k, t, "en", "s", None if t is None else len(t), "k", 1, 0.5, 3, "b") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Null, empty, wordless, short, copied, nearly copied, overlapping, repetitive and very long texts."""
    rng = random.Random(4)
    a, b, c = prose(rng, 120), prose(rng, 200), prose(rng, 60)
    near = a.split()
    near[17] = "changed"
    many = []
    for k in range(40):
        w = b.split()
        w[(k * 5) % 200] = f"x{k}"
        many.append(" ".join(w))
    return [None, "", "  \n!?", "one", "one two three", "One, two; THREE", a, a, " ".join(near), b, b[:400] + c, c + " " + a[100:300], "aa " * 300, "aa " * 290, "é" * 80, prose(rng, 20_000), prose(rng, 5), *many, a.upper(), "word " * 4 + "end"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
