import pytest

from lectern.llm.common import configured


@pytest.fixture(autouse=True)
def _configured(spark):
    configured(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated rows, rows that share an id, and clashing names."""
    long = " ".join(f"wort{i % 977}" for i in range(30_000))
    rows = [(1, "Plain text, of some words.", "x"), (1, "Plain text, of some words.", "x"), (2, None, None), (3, "", "y"), (4, " \n\t ", None), (None, "no id here", "z"), (5, long, "z"), (6, long + " ende", "z"), (7, "same id", "a"), (7, "other text", "b"), (8, "ß € 漢字 é́ \U0001f600", None)]
    return spark.createDataFrame([(i, t, k, k, 3, "k", "s", "e", "m", 0.5) for i, t, k in rows], "doc_id long, text string, key string, label string, n int, count string, spans string, row string, bucket string, score double")


@pytest.fixture(scope="session")
def prose():
    """Invented documents with copies, near copies and shared passages."""
    import random

    rng = random.Random(17)
    words = [a + b for a in "ba de ki lo mu ne po ra su ti".split() for b in "lan mer dos tik fen gar".split()]
    shared = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randrange(3, 220))]
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = shared[i % 3].split()
        if i % 7 == 3 and i > 10:
            body = docs[i - 7].split()
            for _ in range(len(body) // 60):
                body[rng.randrange(len(body))] = "neu" + str(i)
        if i % 11 == 5 and i > 10:
            body = docs[i - 5].split()
        docs.append("".join(w + (rng.choice([" ", " ", " ", "\n", "  "])) for w in body).strip())
    return docs
