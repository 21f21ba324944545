import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType())])


@pytest.fixture(scope="session")
def frame(spark):
    """``documents`` from (doc_id, text) pairs, with a column whose name clashes."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)

    return make


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


@pytest.fixture(scope="session")
def prose():
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def twins():
    """Two different words of 4096 letters that a polynomial modulo 2^64 cannot tell apart, whatever its base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    return one, one.translate(str.maketrans("ab", "ba"))
