import random

import pytest

WORDS = ["the", "of", "and", "Ärger", "été", "x1", "A-b", "cat", "Dog", "run", "sun", "lamp", "tree", "rock", "fish", "bird", "moon", "star", "rain", "wind"]


def prose(rng, n, words=WORDS):
    out = []
    for i in range(n):
        out.append(rng.choice(words) + (str(rng.randint(0, 400)) if rng.random() < 0.7 else ""))
        out.append("\n" if rng.random() < 0.08 else rng.choice([" ", " ", " ", "  ", "\t", ", "]))
    return "".join(out)


def corpus(seed=1, n=60):
    """(doc_id, text): prose, copies, near copies, shared passages and lines, nulls, blanks, one long text."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 160))) for i in range(n)]
    shared = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(70))
    for i in range(n, n + 12):
        rows.append((i, prose(rng, 30) + " " + shared + "\nAll Rights Reserved \n" + prose(rng, 20)))
    base = prose(rng, 150).split(" ")
    for i in range(n + 12, n + 24):
        edit = list(base)
        for _ in range(rng.randint(0, 6)):
            edit[rng.randrange(len(edit))] = "edit"
        rows.append((i, " ".join(edit)))
    rows += [(500 + i, rows[i][1]) for i in range(5)]
    rows += [(600, None), (601, ""), (602, " \n\t "), (603, "one"), (604, "one two"), (None, "no id here at all"), (605, prose(rng, 9000)), (3, rows[3][1]), (606, "a" * 5000), (607, "\n\n"), (608, "é ß x ￿ 日本")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names operators use inside."""
    wide = [(i, t, "l", n, "h") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, n_words int, hi string").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_row(found, *columns):
    """Sorted tuples of the named columns, ids first."""
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
