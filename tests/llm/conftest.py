import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with exact copies, near copies, a very common passage, empty, null and one long text."""
    rng, texts = random.Random(seed), []
    common = passage(rng, 60)
    for i in range(n):
        if i % 5 == 0 and texts:
            words = (texts[i // 2] or "x").split(" ")
            words[rng.randrange(len(words))] = f"edit{i}"
            texts.append(" ".join(words))
        elif i % 7 == 0 and texts:
            texts.append(texts[rng.randrange(len(texts))])
        elif i % 3 == 0:
            texts.append(f"{passage(rng, 30)}\n{common}\n{passage(rng, 40)}")
        else:
            texts.append("\n".join(passage(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 5))))
    return [*texts, "", None, "one two", "ONE two", passage(rng, 6000)]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with clashing extra columns, a null id and a repeated row."""
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, -1) for i, t in enumerate(corpus())]
    rows += [(None, "a null id here", "s1", -1), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size int")
