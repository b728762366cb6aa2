import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, cid string"


def words(rng, n, lang="en"):
    parts = {"en": ["th", "er", "ing", "on", "an", "re", "ed", "nd"], "fr": ["eau", "ré", "eux", "oi", "ment", "è", "que", "la"]}[lang]
    return [("".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def make_rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    out = []

    def add(text, lang="en", source="a"):
        out.append((len(out), text, lang, source, None if text is None else len(text), "x", "y"))

    base = words(rng, 150)
    for k in range(6):
        w = list(base)
        if k:
            w[10 * k] = "changed"
        add(" ".join(w), source="hot")
    for _ in range(4):
        add(" ".join(words(rng, 60)) + " " + passage + " " + " ".join(words(rng, 30)), source="b")
    copy = " ".join(words(rng, 120, "fr"))
    for _ in range(3):
        add(copy, "fr", "hot")
    add(None)
    add("", None)
    add("  \n\t ", "en", None)
    add("one two three")
    add("one two three", source="c")
    add("a" * 700)
    add("é" * 150 + " ab" * 200, "fr")
    for k in range(14):
        add(" ".join(words(rng, rng.randint(20, 90), "fr" if k % 2 else "en")) + ".\n" + " ".join(words(rng, 20)) + ".", "fr" if k % 2 else "en", "abc"[k % 3])
    add(" ".join(words(rng, 8000)), source="hot")
    out.append(out[7])  # a repeated row
    return out


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows that are null in every column, and some that are null in one."""
    return spark.createDataFrame([(None, None, None, None, None, None, None), (None, "some words here to read", "en", "a", 1, None, None), (1, None, None, None, None, None, None), (1, None, None, None, None, None, None)], SCHEMA)
