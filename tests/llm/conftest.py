import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, blanks, ties, repeats, long texts and odd characters."""
    base = [prose(i, 40 + 13 * i) for i in range(12)]
    near = base[3].split()
    near[5] = "changed"
    return [None, "", "   \n\t", "one", "two words", *base, base[2], base[2], " ".join(near), base[4] + " tail end", prose(99, 30_000), "İstanbul ſ K naïve   x\u0000y", "日本語 текст 😀😀 á", "a" * 5000, "!!!" * 900, "Ünï 1234 5,678.90\r\n\r\n  x"]


@pytest.fixture()
def docs(spark, texts):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(3)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
