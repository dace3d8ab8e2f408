import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, part int, block int, fingerprint string, n long, line string, candidates string"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeñü") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    lines = lambda n: "\n".join(words(rng.randint(3, 12)) + "." for _ in range(n))
    base = [lines(rng.randint(1, 12)) for _ in range(40)]
    out = list(base)
    out += [base[0]] * 9 + [base[1], base[2]]  # copies
    out += [t.replace(t.split()[3], "changed", 1) for t in base[3:9] if len(t.split()) > 3]  # near copies
    passage = words(60)
    out += [words(20) + "\n" + passage + "\t" + words(15) for _ in range(5)]  # a shared passage
    out += ["", "", None, None, " \n\t ", "one", "one two", "One Two", "ONE  two", base[4].upper(), "é " * 40, "same " * 300]
    out += [words(30000)]  # a very long text
    return out


@pytest.fixture(scope="session")
def rows():
    texts = _texts()
    order = list(range(len(texts)))
    random.Random(9).shuffle(order)
    found = [(i, texts[k], ["en", None][k % 2], [None, "a", "b", "b", "ü"][k % 5], len(texts[k]) if texts[k] and k % 3 else None) for i, k in enumerate(order)]
    found += [found[0], found[1], found[1]]  # repeated rows
    found += [(None, "no number here at all", None, None, None), (None, None, None, None, None)]
    return [(*r, 7, "k", 1, None, "f", 3, "l", "c") for r in found]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
