import random

import pytest

#: Extra columns whose names operators use inside.
EXTRA = ", id long, n long, key string, token long, score double, uid long, mix_tokens long, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows and ids, a very long text and near copies of it."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    mid = words(rng, 300)
    edit = mid.split()
    edit[150] = "changed"
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "a b"), (7, long), (8, long + " tail"), (9, mid), (10, " ".join(edit)), (11, mid), (12, mid), (12, mid), (None, mid), (13, mid[: len(mid) // 2]), (14, "é ñ 中文 \U0001f600 <|endoftext|>"), (15, "x" * 5000), (16, "a b c"), (17, "a b c d")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, 7, 7, "k", 7, 0.5, 7, 7, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, 0) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string" + EXTRA)
