"""Small tables with nulls, empty and long texts, repeated rows and columns of other names."""

import random

import pytest


def make_texts(seed=1, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 160))) for _ in range(n)]
    shared = " ".join(r.choice(words) for _ in range(120))
    out = [*base, base[3], shared + " x " + base[4], base[5] + "\n" + shared, "", "   ", None, "one", "a b", "tab\tand space  two", "q" * 900]
    near = base[6].split(" ")
    return [*out, " ".join(near[:-1] + ["changed"])]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and two columns whose names the operators use themselves; one row twice, one id with two texts, two rows without id."""
    rows = [*enumerate(texts), (3, texts[3]), (5, texts[8]), (None, texts[6]), (None, None)]
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, id int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
