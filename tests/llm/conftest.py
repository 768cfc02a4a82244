import random

import pytest

#: Columns whose names the operators use inside.
CLASHING = "fp norm row score words size order position copy name bucket start path_length kept text_sha256 component_id ids __gone cell"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank, repeated and tied rows, and columns with clashing names."""
    rows = [
        (1, "The same text, more or less", "en", "a"),
        (2, "The same  text,\nmore or less", "en", "b"),
        (2, "The same  text,\nmore or less", "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n", "de", None),
        (None, "a text without a number to it", "en", "a"),
        (None, None, None, None),
        (7, "x" * 30_000 + " y", "en", "b"),
        (8, "Größe café \U0001f600 İK   end", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for k, name in enumerate(CLASHING.split()):
        df = df.selectExpr("*", f"'{k}' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def corpus(n=150, seed=1):
    """Random texts with exact copies, near copies and short ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 300))) for _ in range(n)]
    for k in range(0, n, 5):
        copy = texts[r.randrange(n)].split(" ")
        if len(copy) > 40 and k % 2:
            copy[r.randrange(len(copy))] = "changed"
        texts.append(r.choice(("", " ", "\n")) + " ".join(copy))
    return texts


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def numbered(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
