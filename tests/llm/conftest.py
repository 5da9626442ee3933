import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for themselves
    T.StructField("id", T.StringType()), T.StructField("rate", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("label", T.StringType()),
])


def edge_texts() -> list[str | None]:
    """Missing, empty, blank, one word, ties, exact and near copies, a shared passage, a very long text, several scripts."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]

    def prose(n: int) -> list[str]:
        return [rnd.choice(words) for _ in range(n)]

    out: list[str | None] = [None, "", " \n\t", "One", "one", "two words", "Two  words"]
    base = prose(300)
    out += [" ".join(base), " ".join(base).upper(), " ".join(base)]
    for at in (10, 150, 290):
        near = list(base)
        near[at] = "changed"
        out.append(" ".join(near))
    passage = " ".join(prose(120))
    out += [" ".join(prose(60)) + " " + passage + " " + " ".join(prose(60)) for _ in range(4)]
    out += [" ".join(prose(40)) for _ in range(12)]
    out += [" ".join(prose(30_000)), "x" * 5000, "x" * 5000 + "y", "ab" * 900]
    out += ["Größe naïve çà 漢字かな <s> <|endoftext|> ​ ﬁ ²", "Ünïcode " * 80]
    return out


@pytest.fixture(scope="session")
def texts():
    return edge_texts()


@pytest.fixture(scope="session")
def edge_docs(spark, texts):
    rows = [(i * 3, t, "en", "hot" if i % 3 else (None if i % 2 else "rare"), None, "x", 1, "b", "l") for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    rows.append((None, "a missing key", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
