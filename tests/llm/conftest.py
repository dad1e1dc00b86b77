import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty, very short and long texts, a hot source, repeated rows and columns with clashing names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, rows = text(60), []
    base = text(120)
    for i in range(90):
        kind = i % 9
        if kind == 0:
            t = base
        elif kind == 1:
            words = base.split()
            words[rng.randrange(120)] = "edited"
            t = " ".join(words)
        elif kind == 2:
            t = f"{text(30)}\n{passage}\t{text(20)}"
        elif kind == 3:
            t = text(3)
        else:
            t = text(rng.randint(20, 150))
        rows.append((i, t, "en" if i % 2 else None, "s0" if i % 3 else ("ü" if i % 2 else None), kind, "clash"))
    rows += [(100, None, "en", "s1", 0, None), (101, "", "en", "s1", 0, None), (102, " \t\n", None, None, 0, None), (103, "One two THREE", "en", "Z", 0, None), (104, "one TWO three", "en", "Z", 0, None)]
    rows += [(105, "loop " * 3000, "en", "s0", 0, None), (106, "ab" * 700, "en", "s0", 0, None)]
    rows += [rows[7], rows[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string").repartition(5).persist()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
