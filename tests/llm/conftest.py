import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
#: Names that operators use inside or give to their results.
CLASH = ["id", "n", "key", "root", "class", "sig", "n_words", "spans", "items", "ids", "n_tokens", "lang_pred", "score", "n_lines", "fingerprint", "bits", "edited", "kept", "block", "cluster"]


def make_words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short, repeated and very long texts, a null id, and a repeated row."""
    a = " ".join(make_words(1, 60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e"), (6, "A B C D E"), (6, "A B C D E"), (None, a), (8, a), (9, a.upper()), (10, LONG), (11, LONG), (12, "é" * 50 + "\n" + "\x00   😀"), (13, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame([(i, t, "en" if k % 2 else None, "src") for k, (i, t) in enumerate(odd_rows)], "doc_id long, text string, lang string, source string")
    return base.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH))).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
