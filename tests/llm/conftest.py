import random

import pytest

EDGES = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n", "en"),
    (4, "one two", "en"),
    (5, "one  two", None),
    (6, "one two", "fr"),
    (7, "123 !? --", "en"),
    (8, "<|endoftext|> it's 's\u00a0x  \n\n \u3000 é\u0301 😀 Σ", "de"),
    (9, "x" * 3000 + " " + "ab-" * 2000, "en"),
    (None, "no id", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases, with further columns whose names operators use themselves."""
    rows = [(*r, "s", "clash", 5) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node string, row int").cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -1")


@pytest.fixture(scope="session")
def prose():
    """Random prose with near copies and passages that documents share."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    shared, out = text(60), []
    for i in range(60):
        body = text(draw.randint(3, 120)) + (shared if i % 3 == 0 else [])
        out.append(body)
        for _ in range(draw.choice((0, 0, 1, 4))):
            copy = list(body)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(copy)
    draw.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]
