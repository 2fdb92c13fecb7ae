import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk long, bands array<long>, label string, part int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwyzéü") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """id -> text: copies, shared passages, edges of all kinds."""
    a, b, c = words(1, 300), words(2, 120), words(3, 60)
    edited = a.split()
    edited[50] = "changed"
    out = {
        1: a,
        2: a,
        3: " ".join(edited),
        4: b + "\n" + c,
        5: c + " " + words(4, 90),
        6: (words(5, 30) + "\n") * 4,
        7: "",
        8: None,
        9: " \t\n ",
        10: "one",
        11: "one",
        12: "two words here",
        13: words(6, 20000),
        14: "🙂" * 150 + " end",
        15: "x" * 700,
        16: "don't stop.'s   　x  y z <|endoftext|> 12ab,,  \n\n  Q",
        17: words(7, 400) + " " + c,
        18: b.upper(),
    }
    for i in range(20, 60):
        out[i] = words(100 + i, 40 + i)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with other columns whose names clash with the operators' own, and one row twice."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 0.5, i, [1], None, 0) for i, t in texts.items()]
    rows.append(rows[0])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def null_docs(spark):
    """Null ids and nulls in all columns."""
    return spark.createDataFrame([(None,) * 10, (None, "some text", *[None] * 8), (5, None, *[None] * 8)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
