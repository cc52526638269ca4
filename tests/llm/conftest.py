import random

import pytest

WORDS = [f"w{k}" for k in range(400)] + "the of and to in is it The, of. on!".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): nulls, empties, copies, near copies, shared passages, repeats, long texts, repeated rows, a null doc_id."""
    base, passage, benchmark = prose(1, 120), prose(2, 60), prose(3, 30)
    near = base.split()
    near[50] = "changed"
    out = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, None, "en"), (5, "", None), (6, " \n\t ", "fr"), (7, "word", "fr"), (8, "... !!! 123 45", "en"),
        (9, prose(4, 50) + " " + passage + " " + prose(5, 50), "en"), (10, prose(6, 30) + "\n" + passage, "fr"), (11, "Su " * 120, "de"), (12, "a b c " * 40, "de"), (13, "x" * 30_000, "de"),
        (14, prose(7, 5000), "en"), (15, prose(8, 40) + " " + benchmark + " tail", "en"), (16, "Ünïcödé — “quotes” naïve J̌ İ 日本語 <|endoftext|> don't I'LL", "fr"), (17, prose(9, 25), "en"), (17, prose(9, 25), "en"), (18, passage, "en"),
        (18, prose(10, 30), None), (None, base, "en"), (None, None, None), (20, "a\x00b \x85 c d", "en"), (21, prose(11, 19), "en"), (22, prose(11, 19) + " w1", "en"), (23, " ", "en"),
    ]
    return out, benchmark


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The rows with extra columns whose names operators use themselves."""
    made = [(i, t, g, "src", None if t is None else len(t), 1, "x", 7) for i, t, g in rows[0]]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, key int, node string, places int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, documents):
    return spark.createDataFrame([], documents.schema)
