from __future__ import annotations

import random

import pytest

WORDS = ["w" + chr(97 + i // 20) + chr(97 + i % 20) for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward():
    """Texts with nothing in them, ties, repeats, odd white space, many scripts, and one that is very long."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [
        None, "", " \n\t", "one", "One", "two words", base, base, base.replace(" ", "\n", 7), base + " tail", "x " + base[: len(base) // 2], "é" * 30 + " ünï çödé", "a\x0bb\x0cc\rd\te", "same same " * 60,
        " nbsp stays joined", "नमस्ते दुनिया यह एक वाक्य है", "日本語 の 文章 です", "12 34 56 78 90", "###" * 50, "\x00nul byte\x00", prose(rng, 30_000), "İstanbul ΑΣ ſ K", "A" * 3000, base.upper(),
    ]
    rows = [(i, t, None if i % 5 == 3 else ("en", "fr")[i % 2], None if i % 7 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows, one of them twice, and columns whose names clash."""
    rows = awkward()
    df = spark.createDataFrame([*rows, rows[6]], SCHEMA)
    return df.selectExpr("*", "'x' AS TEXT", "1 AS kept", "2 AS start", "3 AS doc", "4 AS size", "5 AS key", "6 AS label")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    """All columns null."""
    return spark.createDataFrame([(None, None, None, None, None), (None, "some text here", None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def related(spark):
    """Copies of every degree, and passages that stand in several documents."""
    rng = random.Random(9)
    rows, passage = [], prose(rng, 60)
    for g in range(12):
        base = prose(rng, rng.choice([8, 60, 200])).split()
        for c in range(rng.choice([1, 2, 5, 40])):
            words = [rng.choice(WORDS) if rng.random() < c * 0.004 else w for w in base]
            text = " ".join(words)
            if rng.random() < 0.2:
                text += "\n" + passage + " " + prose(rng, 5)
            rows.append((len(rows), text, "en", f"s{g % 3}", len(text)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
