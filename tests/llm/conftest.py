import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, class string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(7)
    syllables = "an er the ti on re sh ou wh ea né ß 中 😀".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(70), prose(12)
    texts = [prose(rng.randint(1, 300)) for _ in range(40)]
    texts += [texts[3]] * 6 + [texts[5]] * 2
    for i in (7, 8, 9):
        words = texts[i].split()
        for _ in range(4):
            changed = list(words)
            changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed))
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(4)]
    texts += ["\n".join([line] * 30), "A" * 700, "ab" * 400, "", " \t\n", "one", "x y", None, prose(9_000)]
    texts += [f"{line}\n{prose(40)}\n{line}\n{line.upper()}" for _ in range(3)]
    rows = [
        (10 * i - 100, t, "en", ("a", "b", None, "a")[i % 4], None if t is None else len(t), "s", "c")
        for i, t in enumerate(texts)
    ]
    rows += [rows[1], rows[1], (None, texts[2], None, None, None, None, None), (None, None, None, "b", None, "s", None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
