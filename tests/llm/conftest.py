import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, uid string, node string, n string, digest string"
#: Columns whose names clash with those that the operators use inside.
CLASH = ("u", "x", "7", "d")


def frame(spark, texts, lang="en", source=None):
    """A documents table with extra columns of clashing names; texts is a list, or a dict by id."""
    pairs = texts.items() if isinstance(texts, dict) else enumerate(texts)
    rows = [(i, t, lang, source[k % len(source)] if source else f"src{k % 3}", None if t is None else len(t), *CLASH) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def words():
    r = random.Random(11)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(3000)]


def prose(words, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def edited(text, words, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(words) if r.random() < share else w for w in text.split(" "))
