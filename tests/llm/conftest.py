import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, hot lines, and every odd case."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = text(120), text(50), text(12)
    rows = [(k, text(rng.randint(1, 150))) for k in range(60)]
    rows += [(100 + k, base) for k in range(6)]  # exact copies
    for k in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, f"{text(20)} {passage}\n{text(30)}") for k in range(8)]
    rows += [(400 + k, f"{line}\n{text(k)}") for k in range(20)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "One  TWO"), (505, "x"), (None, base), (None, "alone among them all is this"), (506, "é" * 3000), (507, text(4000)), (508, line), (508, line)]
    rows += [(509, "a b " * 60), (510, "Ünï ﬁ ½ ▁x  ▁▁ y\n\n z \r\n; 日本語 🙂 </s>[INST] ok  ")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The rows as a table in several partitions, with columns whose names clash with inner ones."""
    extra = ["key", "bucket", "h", "at", "s1", "n", "c1", "_swap", "pii", "ids", "score", "root"]
    rows = [(*r, *range(len(extra))) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in extra)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
